from ledgerlens.functions.text import canonical_path
from ledgerlens.operators import draft

PATHS = {
    "/v/a.mp4": "/v/a.mp4", "/v/./a//b/": "/v/a/b", "/v/x/../a": "/v/a", "/../../a": "/a", "C:\\in\\..\\a.mp4": "C:/a.mp4", "c:/": "c:/", "/": "/", "a/../../b": "../b", "../../a": "../../a",
    "\\\\host\\share\\x\\..\\..\\y": "//host/share/y", ".": "", "": "", "a\0b": None, None: None, "a/b/../c/./d": "a/c/d",
}


def test_canonical_path(spark):
    df = spark.createDataFrame(list(enumerate(PATHS)), "k int, p string")
    got = {r.p: r.c for r in df.select("p", canonical_path(df.p).alias("c")).collect()}
    assert got == PATHS


def test_options(spark):
    drafts = spark.createDataFrame([(1, "n", "/w/x", None, "m.vwpkg", False), (2, "n", "/w/x", None, None, None), (3, "n", "/w/x", None, "m.vwpkg", True)], "draft int, name string, workspace string, staging string, package string, package_found boolean")
    items = spark.createDataFrame([(1, 1, "/v/a.mp4", False, False, None), (1, 2, "/v/./A.MP4", True, False, None), (1, 3, "/v/\0.mp4", False, False, None), (3, 1, "/v/a.mp4", True, True, None)], "draft int, item int, path string, archived boolean, found boolean, grp string")
    groups = spark.createDataFrame([], "draft int, grp_item int, grp string, grp_name string")
    found = lambda **o: sorted((r.draft, r.item, r.code.split(".")[1]) for r in draft.issues(drafts, items, groups, **o).collect())
    base = [(1, 2, "Duplicate"), (1, 3, "InvalidPath")]
    assert found() == sorted(base + [(1, 0, "NotFound"), (1, 1, "NotFound"), (2, 0, "Required")])
    assert found(check_sources=False) == sorted(base + [(2, 0, "Required")])
    assert found(check_sources=False, require_input=False) == base
    assert draft.issues(drafts.drop("package_found").limit(0), items.limit(0), groups).count() == 0

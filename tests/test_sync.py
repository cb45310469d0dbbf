"""Directory sync: a broken file is its own row, and nothing is lost by it."""

import pytest

from weftlight.sources import sync
from weftlight.sources.snapshots import Store


def put(root, **files):
    for name, data in files.items():
        path = root / name.replace("__", "/").replace("_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)


def state(store):
    return {r["path"]: (r["version"], r["text"]) for r in store.read("documents").collect()}


def outcomes(df):
    return {r["path"]: r["outcome"] for r in df.collect()}


def test_new_changed_failed_and_deleted_files(spark, tmp_path):
    root, store = tmp_path / "kb", Store(spark, str(tmp_path / "s"))
    put(root, a_md=b"# A", sub__b_txt="é text".encode(), bad_txt=b"\xff\xfe\x00broken", empty_md=b" \n", chart_png=b"png", x_exe=b"no", **{"sub__deep__c_html": b"<p>x</p>"})
    put(root, **{".git__note_md".replace(".", "DOT"): b"left out"})
    (root / "DOTgit").rename(root / ".git")
    first = sync.sync(store, str(root))
    assert outcomes(first) == {"a.md": "new", "sub/b.txt": "new", "sub/deep/c.html": "new", "bad.txt": "failed", "empty.md": "failed", "chart.png": "failed"}
    errors = {r["path"]: r["error"] for r in first.collect() if r["error"]}
    assert errors["bad.txt"].startswith("UnicodeDecodeError") and errors["empty.md"] == "ValueError: no text" and errors["chart.png"] == "ValueError: no reader for image"
    assert state(store) == {"a.md": (1, "# A"), "sub/b.txt": (1, "é text"), "sub/deep/c.html": (1, "<p>x</p>")}
    put(root, a_md=b"# A2", sub__b_txt=b"\xff now broken", bad_txt=b"mended")
    (root / "sub/deep/c.html").unlink()
    second = sync.sync(store, str(root))
    assert outcomes(second) == {"a.md": "changed", "sub/b.txt": "failed", "bad.txt": "new", "sub/deep/c.html": "deleted", "empty.md": "failed", "chart.png": "failed"}
    assert state(store) == {"a.md": (2, "# A2"), "sub/b.txt": (1, "é text"), "bad.txt": (1, "mended")}
    put(root, sub__b_txt=b"back")
    third = sync.sync(store, str(root), readers=sync.READERS | {"image": lambda b: f"{len(b)} bytes"})
    assert outcomes(third) == {"a.md": "unchanged", "sub/b.txt": "changed", "bad.txt": "unchanged", "empty.md": "failed", "chart.png": "new"}
    assert state(store)["sub/b.txt"] == (2, "back") and state(store)["chart.png"] == (1, "3 bytes")
    assert len(store.read("documents", version=1).collect()) == 3


@pytest.mark.parametrize(("glob", "yes", "no"), [(".git/**", ".git/a/b.md", "x/.git/a.md"), ("**/*.md", "a.md", "a.txt"), ("**/*.md", "x/y/a.md", "a.mdx"), ("notes/*.md", "notes/a.md", "notes/x/a.md"), ("a?c.md", "abc.md", "a/c.md"), ("x.y/**", "x.y/z", "xzy/z")])
def test_globs(glob, yes, no):
    import re

    assert re.match(sync.glob_pattern(glob), yes) and not re.match(sync.glob_pattern(glob), no)

"""Registered work runs over whole tables: `.limit` appears only where it is the feature."""

from __future__ import annotations

import pathlib
import re

ALLOWED = {
    ("operators/worksheet.py", "top_failures"),  # X4: the top-5 report itself
}


def modules(root: pathlib.Path) -> list[pathlib.Path]:
    """The report library; the training-data subpackage has its own rules and tests."""
    return [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]


def test_limit_only_where_it_is_the_feature():
    root = pathlib.Path(__file__).resolve().parents[1] / "ledgerlens"
    found = set()
    for path in modules(root):
        src = path.read_text()
        for m in re.finditer(r"\.limit\(", src):
            func = re.findall(r"^def (\w+)", src[: m.start()], flags=re.M)[-1]
            found.add((str(path.relative_to(root)), func))
    assert found <= ALLOWED, found - ALLOWED


FORBIDDEN = (r"\budf\(", r"pandas_udf", r"applyInPandas", r"mapInPandas", r"\.rdd\b", r"localCheckpoint", r"crossJoin")


def test_no_python_udfs_rdds_or_cross_joins_in_the_library():
    root = pathlib.Path(__file__).resolve().parents[1] / "ledgerlens"
    hits = []
    for path in modules(root):
        src = path.read_text()
        for pat in FORBIDDEN:
            if re.search(pat, src):
                hits.append((str(path.relative_to(root)), pat))
        if ".collect()" in src:
            hits.append((str(path.relative_to(root)), "collect"))
    assert not hits, hits

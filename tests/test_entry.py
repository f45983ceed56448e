"""The driver's entry, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["canonical", "page_id", "title", "body_sha256", "outbound_links"] and df.count() > 0


def test_entry_without_the_subpackage(tmp_path):
    for name in ("lodestone", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm")) if os.path.isdir(src) else shutil.copy(src, tmp_path)
    (tmp_path / "lodestone" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'page_catalog' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_subpackage():
    for base, _, names in os.walk(os.path.join(ROOT, "lodestone")):
        if "llm" not in os.path.relpath(base, ROOT).split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    assert "lodestone.llm" not in open(os.path.join(base, n), encoding="utf-8").read(), n

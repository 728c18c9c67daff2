"""Every query has a name of its own, every SQL text a query, and the core stands without the llm part."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    from strandworks.plans import registry

    names = [n for m in registry.MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))


def test_core_imports_no_llm():
    code = "import sys; sys.modules['strandworks.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p6_found' in q and 'p1_found' not in q; assert not [m for m in sys.modules if m.startswith('strandworks.llm.')]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in (ROOT / "strandworks").rglob("*.py"):
        if "llm" not in p.parts:
            assert "strandworks.llm" not in p.read_text(), p


def test_only_absence_is_excused():
    """A fault inside the training-data part is an error, not fewer queries."""
    code = "import sys; sys.modules['strandworks.llm.queries'] = None; import __spark_entry__ as e; e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode != 0 if (ROOT / "strandworks" / "llm").exists() else True


def test_shared_folder_is_asked_for():
    from types import SimpleNamespace

    from strandworks.runtime import checkpoint_dir

    conf = SimpleNamespace(get=lambda name, default: default)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master)))


def test_flagship(spark):
    from strandworks.plans import registry

    if Path("/root/testdata/sf0.001").exists():
        df = registry.flagship(spark, "/root/testdata/sf0.001")
        assert df.limit(1).count() == 1


def test_bounds_raise(spark, monkeypatch):
    """A vocabulary or set of models beyond the bound is an error, not cut off."""
    from pyspark.sql import functions as F

    from strandworks.plans import eval_queries, text_queries

    many = spark.range(10_001).select(F.concat(F.lit("r"), "id").alias("relation"))
    some = spark.createDataFrame([("a1", "h", "r1")], "id string, head string, relation string")
    monkeypatch.setattr(text_queries, "table", lambda spark, sf_dir, name: many if name == "relation_map" else some)
    models = spark.range(1001).select(F.lit(1).alias("item_id"), F.lit(1).alias("k_hops"), F.concat(F.lit("m"), "id").alias("model"), F.lit("yes").alias("verdict"))
    monkeypatch.setattr(eval_queries, "verdicts", lambda spark, sf_dir: models)
    for q in (text_queries.n6_allowed_relations, text_queries.r1_relation_maps, text_queries.r2_relation_rows, eval_queries.r10_long_results):
        with pytest.raises(ValueError, match="more than"):
            q(spark, "")

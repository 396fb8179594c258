"""Workers that cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as contract
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1").getOrCreate())
def importable(batches):
    import importlib.util, pyarrow as pa
    for _ in batches:
        yield pa.record_batch([pa.array([importlib.util.find_spec("mailrank") is not None])], names=["there"])
assert not spark.range(1).mapInArrow(importable, "there boolean").first().there
queries = contract.queries()
for name in ("op2_toxicity", "op10_byte_bpe", "op11_conversation_trie", "op12_collocations", "op13_sharding"):
    assert queries[name](spark, {sf!r}).count() > 0, name
docs = spark.read.parquet({sf!r} + "/documents.parquet").limit(20)
import corpus_pipeline
assert corpus_pipeline.STAGES[-1][1](spark, docs, {sf!r}).count() == 20
print("all ended")
"""


def test_queries_on_workers_without_the_package(sf_dir, tmp_path):
    root = str(Path(__file__).resolve().parents[2])
    path = ":".join(p for p in os.environ.get("PYTHONPATH", "").split(":") if p and os.path.realpath(p) != os.path.realpath(root))
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root, sf=sf_dir)], cwd=tmp_path, env={**os.environ, "PYTHONPATH": path}, capture_output=True, text=True, timeout=600
    )
    assert "all ended" in done.stdout, done.stderr[-3000:]

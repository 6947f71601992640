"""What a Python worker holds while it repairs many documents."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.operators import repair

TEXT = "".join(f"## **Part {i}\b** **{i}**\n\n- * **Ctrl* + *F*: Searches {i}\n\n\n\n" for i in range(40))


def workers():
    """(resident, greatest resident) MB of each Python worker since reset()."""
    found = {}
    for p in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{p}/cmdline") as cmd, open(f"/proc/{p}/status") as status:
                if "pyspark.daemon" in cmd.read():
                    said = dict(line.split(":", 1) for line in status)
                    found[p] = tuple(int(said[k].split()[0]) / 1024 for k in ("VmRSS", "VmHWM"))
        except OSError:  # it ended meanwhile
            pass
    return found


def grown(spark, run):
    """MB by which the largest worker grew while run repaired 5000 documents in one task, over the largest one before."""
    repair.repair(spark.range(8, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))).collect()  # a worker with its imports
    before = workers()
    for p in before:
        with open(f"/proc/{p}/clear_refs", "w") as f:
            f.write("5")  # the greatest so far is forgotten
    run(repair.repair(spark.range(5000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit(TEXT).alias("text"))))
    return max(most for _, most in workers().values()) - max(now for now, _ in before.values())


def test_worker_memory(spark):
    got = []
    assert grown(spark, lambda rows: got.append(repair.totals(rows).first())) < 150
    _, log = repair.repair_text(TEXT)
    assert [tuple(r) for r in got] == [(5000, 5000, 5000 * len(log))]


def test_worker_memory_of_rows(spark, tmp_path):
    """The same where all rows are written, as by repair_corpus."""
    assert grown(spark, lambda rows: rows.drop("changes").write.parquet(str(tmp_path / "out"))) < 150
    new, _ = repair.repair_text(TEXT)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.where(F.col("repaired") == new).select("doc_id").distinct().count() == rows.count() == 5000


def test_every_document_once(spark, monkeypatch):
    """Whatever is handed on at a time: all documents, in their order, with their own changes."""
    texts = [None, "", TEXT, "a\n\n\nb", *(TEXT[i:] for i in range(0, len(TEXT), 97)), "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = [(i, new, [tuple(c) for c in log]) for i, (new, log) in enumerate(repair.repair_text(t or "") for t in texts)]
    got = [(r.doc_id, r.repaired, [tuple(c) for c in r.changes]) for r in repair.repair(docs).collect()]
    assert got == want
    batch = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(len(texts))], "original_sha256": ["h"] * len(texts), "text": texts})
    for size, least in ((1, 50), (5000, 20), (1 << 30, 2)):
        monkeypatch.setattr(repair, "HANDED_ON", size)
        out = list(repair._repaired(iter([batch, batch.slice(0, 0), batch])))
        rows = [r for b in out for r in b.to_pylist()]
        assert [(int(r["doc_id"]), r["repaired"], [tuple(c.values()) for c in r["changes"]]) for r in rows] == want + want
        assert len(out) >= least and (size < 1 << 30 or len(out) == 2)

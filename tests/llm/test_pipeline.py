"""The stages against plain versions of what they decide."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from tablewake.llm import language, toxicity
from tablewake.llm.queries import language_may_learn, toxicity_may_learn

from .test_decontaminate import plain_matches
from .test_simhash_dedup import plain_components, plain_fingerprint


def test_stages_on_all_their_predecessors_kept(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, seen = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        if name == "toxicity":
            model = toxicity.fit(docs.where(toxicity_may_learn()), spark.read.parquet(f"{small}/labels.parquet"))
            want = {i for i, t in seen.items() if model.score([t])[0] < toxicity.THRESHOLD}
        elif name == "language_id":
            profiles = language.learn(docs, language_may_learn())
            want = {i for i, t in seen.items() if profiles.predict(t)[0] != language.UNKNOWN}
        elif name == "near_dedup":
            prints = {i: plain_fingerprint(t) for i, t in seen.items()}
            nodes = set(prints.values())
            root = plain_components([(a, b) for a in nodes for b in nodes if (a ^ b).bit_count() <= 3], nodes)
            first = {}
            for i in sorted(seen):
                first.setdefault(root[prints[i]], i)
            want = set(first.values())
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            want = set(seen) - {i for i, _ in plain_matches(seen.items(), items)}
        out = str(tmp_path / name)
        stage(spark, docs, small).write.parquet(out)
        docs = spark.read.parquet(out)
        if name == "packing":
            pieces = Counter()
            for r in docs.collect():
                pieces[r.doc_id] += r.length
            assert set(pieces) == set(seen)
        else:
            assert docs.columns == columns
            kept = {r.doc_id: r.text for r in docs.collect()}
            assert kept == {i: seen[i] for i in want}
            seen = kept


def written(spark, folder, docs, small):
    """A folder of the tables that the pipeline reads, with other documents."""
    docs.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_odd_rows_pass_through_all_stages(spark, small, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, and columns named like those that stages add."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    text = docs.first().text
    odd = [(None, text + " so without an id", "en"), (None, None, None), (800001, None, "en"), (800002, "", None), (800003, text[:300] * 400, "en")]
    odd += [(800004, text[::-1], "en")] * 2
    extra = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in odd], docs.schema)
    clash = ("score", "predicted", "toxic", "lang_pred", "name", "component_id", "start", "sequence_id", "__in0")
    mixed = docs.unionByName(extra).withColumns({c: F.lit("clash") for c in clash})
    folder = written(spark, tmp_path, mixed, small)
    kept = mixed
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == mixed.columns
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    # A text without a letter has no language; repeated rows are one document; rows without an id are packed.
    assert not ids & {800001, 800002} and {None, 800003} <= ids
    assert sum(r.length for r in rows if r.doc_id == 800003) > 40_000


def test_no_documents(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    assert corpus_pipeline.run(spark, written(spark, tmp_path, docs, small)).count() == 0


def test_documents_in_no_known_language_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plain = docs.where("text rlike '[a-z]{3}'")
    other = {900001: "Съешь ещё этих мягких булок", 900002: "日本語の文章", 900003: "12 !"}
    odd = [docs.limit(1).withColumns({"doc_id": F.lit(i).cast("long"), "text": F.lit(t), "lang": F.lit(None).cast("string")}) for i, t in other.items()]
    mixed = plain
    for one in odd:
        mixed = mixed.unionByName(one)
    kept = sorted(r.doc_id for r in corpus_pipeline.keep_known_language(spark, mixed, small).collect())
    assert kept == sorted(r.doc_id for r in plain.collect())


def test_entry_without_the_subpackage(tmp_path):
    """The entry point works with these folders gone, but does not hide a broken import inside them."""
    repo = Path(__file__).resolve().parents[2]
    for name in ("checks", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(repo / name)
    (tmp_path / "tablewake").mkdir()
    for part in (repo / "tablewake").iterdir():
        if part.name != "llm":
            (tmp_path / "tablewake" / part.name).symlink_to(part)
    code = "import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; print(any(n.startswith('op') for n in e.queries()))"
    entry = (repo / "__spark_entry__.py").read_text()
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(entry)
    for broken in (False, True):
        if broken:
            (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
        ran = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, cwd=tmp_path)
        assert (ran.returncode != 0) == broken, ran.stderr
        assert broken or ran.stdout.strip() == "False"

import re
from collections import defaultdict
from pathlib import Path

import brute
import duckdb
import pytest
from pyspark.sql import functions as F
from test_near import brute as near_copies
from test_quality import brute_measures

import corpus_pipeline
from nearfield.llm import common, queries
from nearfield.llm.quality_rules import SYMBOLS

SF = "/root/testdata/sf0.001"


def test_stages_return_documents_that_they_were_given(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {tuple(r) for r in docs.collect()}
    sizes = [len(rows)]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = [tuple(r) for r in out.collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= rows
        docs, rows = out, set(kept)
        sizes.append(len(rows))
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    packed = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert packed == {r[0] for r in rows}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == packed


def passes_rules(docs):
    """The ids of documents that the rules keep; hosts whose rates don't differ fail by the mean of all."""
    fails, base = {}, {}
    for i, t, host in docs:
        words, chars, symbols, lines, repeated = brute_measures(t)
        base[i] = words < 10 or 100 * repeated > 20 * words
        fails[i] = base[i] or 100 * symbols > 10 * words or 100 * lines > 30 * words or not 2 <= chars / max(1, words) <= 15
    by = defaultdict(list)
    for i, _, host in docs:
        by[host].append(fails[i])
    n, mean = len(docs), sum(fails.values()) / len(docs)
    square = sum(sum(f) ** 2 / len(f) for f in by.values()) / n
    between = (square - mean**2 - mean * (1 - mean) * (len(by) - 1) / n) / (1 - sum(len(f) ** 2 for f in by.values()) / n**2)
    strength = max(2.0, mean * (1 - mean) / between - 1) if between > 0 else n
    rate = {h: (sum(f) + strength * mean) / (len(f) + strength) for h, f in by.items()}
    return {i for i, _, host in docs if not base[i] and rate[host] <= 0.5}


def test_stages_against_brute_force(spark):
    """Each stage on all that the one before kept, by doc_id; all 200 documents are in the classifier's sample."""
    assert SYMBOLS == "#*$%&|<>"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    scores = brute.quality_scores([t for _, t, _ in rows])
    want = [{i for (i, _, _), s in zip(rows, scores) if s >= 0.5}]
    assert all(abs(s - 0.5) > 1e-3 for s in scores)
    left = lambda: [x for x in rows if x[0] in want[-1]]
    want.append(passes_rules(left()))
    texts = defaultdict(list)
    for i, t, _ in left():
        texts[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    want.append({min(ids) for ids in texts.values()})
    want.append(near_copies([(i, t.translate({c: c + 32 for c in range(65, 91)})) for i, t, _ in left()]))
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want):
        docs = common.stash(stage(spark, docs, SF), "test-stage")
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == ids, name
    assert len(want[0]) < 200 and [len(x) for x in want] == sorted(map(len, want), reverse=True)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == want[-1]


def test_a_scratch_leaves_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = Path(common.shared_dir(spark)) / "nearfield" / spark.sparkContext.applicationId
    files = lambda: {p for p in folder.rglob("*.parquet")} if folder.exists() else set()
    tables = lambda: {t.name for t in spark.catalog.listTables()}
    before, named = files(), tables()
    with common.scratch():
        assert queries.op1_line_dedup(spark, SF).count() == queries.op7_byte_bpe(spark, SF).count() == docs.count()
        assert files() > before
    assert files() == before and tables() == named
    with pytest.raises(ZeroDivisionError), common.scratch():
        common.stash(docs, "lost")
        1 / 0
    assert files() == before


def test_parts_follow_the_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.parts_for(docs) == least and common.parts_for(docs, 1000) > least
    assert common.parts_for(docs, 1000) > common.parts_for(docs, 2000)


@pytest.mark.parametrize("name", ["op1_line_dedup", "op5_sharding", "op8_exact_dedup", "op9_quality_rules"])
def test_queries_of_odd_rows_against_sql(spark, documents, odd, tmp_path, name):
    """Nulls, repeated rows and repeated doc_ids, and columns with the names that operators use inside."""
    line = "a line that is long enough to be counted as one"
    rows = odd * 2 + [(i, f"{line}\n{i}") for i in (1, 1, 1, 2, 3)] + [(i, f" {line.upper()} and more\nx") for i in (1, 2, 3, 4, None, None)]
    documents(rows, source=lambda i: None if i is None else f"h{i % 3}").write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = duckdb.sql(queries.ORACLE_SQL[name]).select(*(f'"{c}"' for c in got.columns)).fetchall()
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_no_rows(documents, odd, spark, stage):
    """Nulls in all columns, repeated rows, and columns with the names that stages use inside."""
    df = documents(odd).unionByName(documents(odd[:4]))
    df = df.unionByName(df.select(*(F.lit(None).cast(t).alias(c) for c, t in df.dtypes)).limit(2))
    out = stage(spark, df, SF)
    assert out.count() >= 0
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == df.columns
    else:
        assert out.agg(F.sum("length")).first()[0] == out.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert stage(spark, documents([]), SF).count() == 0


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, SF)
        rel = con.sql(sql)
        want = sorted(map(repr, rel.select(*(f'"{c}"' for c in got.columns)).fetchall()))
        assert sorted(repr(tuple(r)) for r in got.collect()) == want, name


def test_fixed_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "exact_dedup", "simhash_dedup", "packing"]
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))


def test_shared_folder(spark, monkeypatch):
    """The session's own setting holds; without one a local session gets a temporary folder, a cluster one in the warehouse."""
    from types import SimpleNamespace as Fake

    from nearfield.llm.common import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    def session(master, app):
        return Fake(conf=Fake(get=lambda k, d=None: {"spark.sql.warehouse.dir": warehouse}.get(k, d)), sparkContext=Fake(master=master, applicationId=app))

    warehouse = "hdfs://w"

    assert shared_dir(session("yarn", "a")) == shared_dir(session("yarn", "a")) == "hdfs://w/_nearfield"
    assert shared_dir(session("local-cluster[3,2,900]", "b")) == "hdfs://w/_nearfield"
    first = shared_dir(session("local[4]", "c"))
    assert "nearfield-" in first and first == shared_dir(session("local[4]", "c"))
    warehouse = "file:/w"
    with pytest.raises(ValueError, match="Set spark.checkpoint.dir"):
        shared_dir(session("yarn", "d"))

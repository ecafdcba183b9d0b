"""The registered queries on the whole tables, against SQL, plain loops or held-out labels."""

import collections
import glob
import hashlib
import re

import duckdb
import numpy as np
import pytest
from cairnlore.llm import bpe, queries

from tests.llm.test_mixing import water_fill
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.test_oracles import plain


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM read_parquet('{path}')")
    df, rel = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_op1(spark, sf_dir, docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe_round_trip(spark, sf_dir).collect())
    want = collections.Counter()
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert got == want


def test_op5(spark, sf_dir, docs):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op5_toxicity(spark, sf_dir).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d.doc_id for d in docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    told = [r for r in rows if toxic.get(r.doc_id) is not None]
    clean = [r for r in told if not toxic[r.doc_id]]
    assert sum(not r.predicted for r in clean) >= 0.97 * len(clean) > 0


def test_op8(spark, sf_dir, docs):
    fps = [slow_fingerprint(d.text) for d in docs]
    want = sorted((d.doc_id, f"{f:016x}", c) for d, f, c in zip(docs, fps, slow_components([d.doc_id for d in docs], fps)))
    assert sorted(map(tuple, queries.op8_simhash(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_op10(spark, sf_dir, docs):
    size = {}
    for d in docs:
        size[d.source] = size.get(d.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, water_fill([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 3)))
    source, taken = {d.doc_id: d.source for d in docs}, collections.Counter()
    rows = queries.op10_mix(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in size)

import hashlib
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from sightline.llm import bpe, mixing, toxicity
from sightline.llm import queries as corpus
from tests.conftest import SF
from tests.llm.test_exact_dedup import brute as exact
from tests.llm.test_near import closure, shingles


def test_stages_against_plain_python(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    score = toxicity.scorer(model)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    rows = [r for r in rows if model.expected(score(r[1] or ""))[1] < toxicity.LIMIT]
    kept = {i for i, _, _, keep, _ in exact([r[:2] for r in rows]) if keep}
    rows = [r for r in rows if r[0] in kept]
    near = closure({r[0]: shingles(r[1]) for r in rows}, 85, 100)
    rows = [r for r in rows if near[r[0]] == r[0]]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(corpus_pipeline.RANKS)), special_tokens={})
    want = Counter()
    for i, text, _ in rows:
        ids = enc.encode_ordinary(text)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids)] += copies[i]
    got = Counter((*tuple(r)[:4], tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want and sum(got.values()) > 100


def test_stage_columns_and_registry(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).columns == docs.columns, name
    assert {q.split("_")[0] for q in corpus.QUERIES if q.startswith("op") or q == "pipeline"} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}


def test_stages_on_rows_with_nulls_repeats_and_clashing_names(spark, tmp_path):
    """Missing ids and texts, rows that share a doc_id, twins, and columns named like the stages' own."""
    line = " ".join(f"word{i}" for i in range(40))
    rows = [(None, None), (None, line), (1, line), (1, "only here"), (2, line + " more"), (3, "twin"), (3, "twin"), (4, ""), (5, "  \n"), (6, "short"), (7, " ".join(f"x{i}" for i in range(3000)))]
    names = ["copies", "key", "row", "all", "owner", "kept", "rows", "text2"]
    df = spark.createDataFrame([(i, t, "en", None if k % 2 else "s", 1, *[k] * len(names)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    texts = lambda x: sorted(str((r.doc_id, r.text)) for r in x.collect())
    clean = corpus_pipeline.drop_toxic(spark, df, str(tmp_path))
    assert clean.columns == df.columns and texts(clean) == sorted(str(r) for r in rows)
    exact_left = corpus_pipeline.drop_exact_copies(spark, clean, str(tmp_path))
    want = [(1, line), (1, "only here"), (2, line + " more"), (3, "twin"), (5, "  \n"), (6, "short"), rows[-1]]
    assert exact_left.columns == df.columns and texts(exact_left) == sorted(map(str, want))
    near_left = corpus_pipeline.drop_near_copies(spark, exact_left, str(tmp_path))
    want.remove((2, line + " more"))
    assert near_left.columns == df.columns and texts(near_left) == sorted(map(str, want))
    mixed = corpus_pipeline.mix(spark, near_left, str(tmp_path))
    assert mixed.columns == df.columns and set(texts(mixed)) <= set(map(str, want)) and max(Counter(texts(mixed)).values()) <= 3
    got = corpus_pipeline.encode(spark, mixed, str(tmp_path)).collect()
    assert len(got) == mixed.count() and all(r.n_tokens == len(r.ids) for r in got)

import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from rostrum.llm import bpe, pii
from tests.llm.test_quality_mix_html_urls import brute_quality
from tests.llm.test_sets_and_vectors import brute_groups


def test_stages_equal_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(rnd.choices(vocab, k=rnd.randint(3, 60))), "en", f"s{k % 4}") for k in range(150)]
    rows = [(i, "Home About Contact\n" + t if h == "s3" else t, g, h) for i, t, g, h in rows]
    rows += [(200 + k, rows[k][1] + (" tail" if k % 2 else ""), "en", "s1") for k in range(40)]
    rows += [(300, "mail me a@b.co or +1 (234) 555-6789 " + " ".join(f"own{i}" for i in range(30)), "en", None), (301, None, None, None), (302, "a b " * 20, "de", "s2")]
    rows = [(*r, len(r[1] or "")) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert len(stage) == 5 and corpus_pipeline.ORACLE_SQL is None
    key = lambda r: tuple(map(str, r))

    good = stage["quality rules"](spark, docs, None)
    texts = []
    verdict = brute_quality([(r[0], r[3], r[1]) for r in rows], 10, 0.1, texts)
    want = [(r[0], t, *r[2:4], len(t)) for r, t, v in zip(rows, texts, verdict) if v[7]]
    assert sum(v[8] > 0 for v in verdict) > 20
    assert sorted(map(tuple, good.collect()), key=key) == sorted(want, key=key) and good.columns == docs.columns

    one = stage["near-duplicates"](spark, good, None)
    keep = {g[0] for g in brute_groups([(r[0], r[1]) for r in want], 5) if g[3]}
    want = [r for r in want if r[0] in keep]
    assert sorted(map(tuple, one.collect()), key=key) == sorted(want, key=key)

    masked = stage["personal data"](spark, one, None)
    a = pii.automaton()
    want = [(r[0], t := pii.masked(r[1], pii.spans_of(r[1], a)), r[2], r[3], len(t)) for r in want]
    assert any("[EMAIL]" in r[1] and "[PHONE]" in r[1] for r in want)
    assert sorted(map(tuple, masked.collect()), key=key) == sorted(want, key=key)

    mixed = stage["source mix"](spark, masked, None)
    uses = Counter(map(tuple, mixed.collect()))
    assert mixed.columns == docs.columns and set(uses) <= set(want) and set(uses.values()) <= {1, 2}
    total = sum(len(r[1].split()) for r in want)
    assert 0.9 * 1.5 * total <= sum(n * len(r[1].split()) for r, n in uses.items()) <= 1.5 * total

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ranks = bpe.read_ranks(bpe.VOCABULARY)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, r.n_tokens) for r in out) == sorted((r[0], len(lib.encode_ordinary(r[1]))) for r, n in uses.items() for _ in range(n))


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Each stage of the pipeline against a plain version of itself, on its own input."""

import re

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from deducta.llm import bpe, decontaminate, near_dup, quality

from .test_decontaminate import greedy
from .test_quality import plain_score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and after.keys() <= before.keys()
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_classifier":
            net = quality.trained(spark, sf_dir, spark.read.parquet(f"{sf_dir}/documents.parquet"))
            ids = sorted(before)
            assert after.keys() == {i for i, s in zip(ids, (plain_score(net, (before[i].text or "").encode()) for i in ids), strict=True) if s >= P.REJECT_BELOW}
        elif name == "near_duplicates":
            lists = {i: near_dup.word_hashes(WORD.findall(r.text or ""), {}) for i, r in before.items()}
            root = {i: i for i in before}
            for i in sorted(before):
                for j in sorted(before):
                    if j > i and (before[i].text == before[j].text or near_dup.similar(lists[i], lists[j])):
                        a, b = root[i], root[j]
                        root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
            assert after.keys() == set(root.values())
        elif name == "substring_dedup":
            first, want = {}, {}
            for i in sorted(before):
                w = WORD.findall(before[i].text or "")
                gone = {q for p in range(len(w) - 49) if first.setdefault(tuple(w[p : p + 50]), i) < i for q in range(p, p + 50)}
                if len(gone) < len(w) or not w:
                    want[i] = before[i].text if not gone else " ".join(x for q, x in enumerate(w) if q not in gone)
            assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
        elif name == "benchmark_decontamination":
            items = [decontaminate.tokens(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            leaks = set()
            for i, r in before.items():
                t = decontaminate.tokens(r.text or "")
                grams = {tuple(t[q : q + 5]) for q in range(len(t) - 4)}
                for item in items:
                    covered = {q + d for q in range(len(item) - 4) if tuple(item[q : q + 5]) in grams for d in range(5)}
                    if len(covered) >= 0.6 * len(item):
                        codes = {w: n for n, w in enumerate(dict.fromkeys(item))}
                        if greedy([codes[w] for w in item], [codes.get(w, -1) for w in t], 5) >= 0.6 * len(item):
                            leaks.add(i)
            assert leaks and after.keys() == before.keys() - leaks
        else:
            one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), special_tokens={})
            assert after.keys() == before.keys() and all(r.ids == one.encode_ordinary(before[i].text) and r.n_tokens == len(r.ids) for i, r in after.items())
        before = after


def test_run_is_the_stages(spark, sf_dir):
    assert P.run(spark, sf_dir).columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids"]


def test_nulls_ties_and_an_empty_table(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words of text", "en", "s", 18), (3, "some words of text", "en", "s", 18)]
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name == "near_duplicates":
                assert docs.count() <= 2
        docs.collect()

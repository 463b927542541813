import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from filmcrate.llm import bpe, common, mixture

SF = "/root/testdata/sf0.01"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        docs = common.settle(stage(spark, docs, SF), name)
        out.append({r["doc_id"]: r for r in docs.collect()} if name != "mixture" else docs.collect())
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = [labels[i] for i in steps[0] if i in labels]
    gone = [t for i, t in labels.items() if i not in steps[0]]
    assert sum(gone) >= 0.8 * len(gone) and sum(gone) >= 0.5 * sum(labels.values()) and len(left) > 300


def test_lines_are_unique_afterwards(steps):
    assert steps[1].keys() == steps[0].keys()
    seen = Counter(x.strip(" ").lower() for r in steps[1].values() for x in (r["text"] or "").split("\n") if len(x.strip(" ")) >= 9)
    assert max(seen.values()) == 1
    assert all(r["n_chars"] == len(r["text"] or "") for r in steps[1].values())


def test_copies_go_and_others_stay(steps):
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, r in steps[1].items() if (w := words(r["text"]))}
    where = defaultdict(list)
    for i, g in grams.items():
        for x in g:
            where[x].append(i)
    near = {}
    for i, g in grams.items():
        shared = Counter(j for x in g for j in where[x] if j != i)
        near[i] = max((c / (len(g) + len(grams[j]) - c) for j, c in shared.items()), default=0.0)
    for i in steps[1]:
        if near.get(i, 0.0) < 0.3:
            assert i in steps[2]
    kept = [i for i in steps[2] if near.get(i, 0) == 1.0]
    assert len({tuple(words(steps[2][i]["text"])) for i in kept}) == len(kept)


def test_mix_repeats_by_target(steps):
    times = Counter(r["doc_id"] for r in steps[3])
    assert max(times.values()) <= 3
    total, sizes = Counter(), {}
    for i, r in steps[2].items():
        sizes.setdefault(r["source"], []).append(len(words(r["text"])))
        total[r["source"]] += times[i] * sizes[r["source"]][-1]
    names = sorted(sizes)
    goal = dict(zip(names, mixture.targets([sum(sizes[s]) for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    # whole documents: a source ends within half its median one, and a slot, of its target
    for s in names:
        middle = sorted(sizes[s])[len(sizes[s]) // 2]
        assert abs(total[s] - goal[s]) <= middle / 2 + mixture.SLOT_WORDS, (s, total[s], goal[s], middle)


def test_tokens(steps):
    coder = bpe.Coder(bpe.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in steps[3]}
    for i, r in list(steps[4].items())[:200]:
        assert list(r["ids"]) == coder.encode([texts[i] or ""])[0] and r["n_tokens"] == len(r["ids"])


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "some words here", "en", None, 3), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "only words of a text " * 20, "en", "b", 1), (4, "only words of a text " * 20, "en", "b", 1)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, SHAPE)
        for name, stage in cp.STAGES:
            docs = common.settle(stage(spark, docs, SF), name)
            assert name == "tokens" or docs.columns == list(cp.COLUMNS)
        assert (docs.count() > 0) == bool(data)

"""Queries without SQL on a small table of documents: golden rows and a brute-force version."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessellis.operators import topics
from tessellis.plans import catalog, text_catalog  # noqa: F401

TEXTS = {
    1: "Prices rose 3,5 % to 1 234 units in 2020, not -2 percent.",
    2: "Exports rose by 3% in 2020; imports fell by 2% while prices were stable. Debt and output rose, while prices fell, respectively.",
    3: "le taux de chômage est dans la moyenne pour les femmes",
    4: "die Preise sind mit der Zeit und für den Handel hoch",
    5: "los precios y las exportaciones del país con el déficit",
    6: "ارتفعت الأسعار في البلاد خلال هذا العام",
    7: "short",
    8: "exports exports of goods and the unemployment rate",
}
HELD_OUT = [
    ("inflation", "annual inflation slowed as consumer prices fell"), ("gdp_growth", "economic growth and gross domestic product"), ("gdp_growth", "la croissance du PIB"),
    ("unemployment", "unemployment among the young fell"), ("unemployment", "le taux de chômage des jeunes"), ("trade_balance", "the trade deficit improved"), ("exports", "صادرات النسيج"),
    ("interest_rate", "la banque centrale et son taux directeur"), ("budget_deficit", "the budget deficit of the state"), ("public_debt", "le poids de la dette publique"),
    ("fdi", "الاستثمار الأجنبي في البلاد"), ("tourism_revenue", "receipts of the tourism season"), ("exchange_rate", "le taux de change du dinar"), ("imports", "imports of wheat"), ("other", "apples and a train on Sunday"),
]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("golden"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return lambda name: catalog.QUERIES[name](spark, at)


def test_languages(run):
    assert {r.doc_id: r.language for r in run("language_fallback").collect()} == {1: "unknown", 2: "en", 3: "fr", 4: "unknown", 5: "unknown", 6: "ar", 7: "unknown", 8: "en"}


def test_numbers(run):
    got = sorted((r.doc_id, r.nr, r.value, r.percent) for r in run("numeric_mentions").collect())
    assert got == [(1, 0, 3.5, True), (1, 1, 1234.0, False), (1, 2, 2020.0, False), (1, 3, -2.0, True), (2, 0, 3.0, True), (2, 1, 2020.0, False), (2, 2, 2.0, True)]


def test_clauses(run):
    got = sorted((r.nr, r.clause_nr, r.clause) for r in run("clause_split").filter("doc_id = 2").collect())
    assert got == [(0, 0, "Exports rose by 3% in 2020"), (0, 1, "imports fell by 2%"), (0, 2, "prices were stable."), (1, 0, "Debt and output rose, while prices fell, respectively.")]


def plain_grams(text):
    """Kind -> gram -> count, by a slow walk."""
    low = text.lower()
    words = re.findall(r"\w{2,}", low)
    pieces = [f" {p} " for p in low.split()]
    return {"word": Counter(words) + Counter(f"{a} {b}" for a, b in zip(words, words[1:])), "character": Counter(p[i : i + n] for p in pieces for n in (3, 4, 5) for i in range(len(p) - n + 1))}


def test_scores_by_brute_force(run):
    described = {c: plain_grams(t) for c, t in topics.DESCRIPTIONS.items()}
    found = {kind: Counter(g for d in described.values() for g in d[kind]) for kind in ("word", "character")}

    def vector(grams):
        out = {}
        for kind, counts in grams.items():
            part = {(kind, g): (1 + math.log(n)) * (math.log(17 / (1 + found[kind][g])) + 1) for g, n in counts.items() if g in found[kind]}
            length = math.sqrt(sum(w * w for w in part.values()))
            out |= {g: w / length for g, w in part.items()}
        return out

    theirs = {c: vector(d) for c, d in described.items()}
    expected = {}
    for k, text in TEXTS.items():
        mine = vector(plain_grams(text))
        kinds = len({kind for kind, _ in mine}) or 1
        expected |= {(k, c): sum(w * d.get(g, 0) for g, w in mine.items()) / math.sqrt(2 * kinds) for c, d in theirs.items()}
    got = {(r.doc_id, r.code): r.score for r in run("semantic_scores").collect()}
    assert got.keys() == expected.keys() and len(got) == 16 * len(TEXTS)
    assert all(abs(got[k] - expected[k]) < 1e-4 for k in got)
    assert max(topics.DESCRIPTIONS, key=lambda c: got[8, c]) == "exports"


def test_topics_of_held_out_sentences(spark, tmp_path):
    topics.train(topics.seeds(spark)).write.parquet(str(tmp_path / "model"))
    rows = spark.createDataFrame([*HELD_OUT, ("blank", " "), ("null", None)], "label string, text string")
    first = topics.predict(spark.read.parquet(str(tmp_path / "model")), rows, ["label", "text"], best=1).collect()
    assert [(r.label, r.text, r.topic) for r in first if r.label != r.topic] == [] and len(first) == len(HELD_OUT)


def test_every_document_has_topics(run):
    got = run("topic_classifier").collect()
    assert sorted((r.doc_id, r["rank"]) for r in got) == [(k, n) for k in TEXTS for n in range(3)]


def test_texts_of_one_task_are_spread(spark):
    rows = spark.createDataFrame([(k, f"the trade deficit of year {k}") for k in range(200)], "doc_id long, text string").coalesce(1)
    scores = topics.similarity(rows, "doc_id", topics.descriptions(spark))
    assert rows.rdd.getNumPartitions() == 1 and scores.select("doc_id", F.spark_partition_id().alias("part")).agg(F.count_distinct("part")).first()[0] > 4


ODD = [
    "", " ", "a", "the", "the the the", "Le taux -　a\x1c\x1dtaux\xa0DE la​banque", "İstanbul\n\n\t rate_1 of \U0001d538\U0001d539 rates", "taux", "de la", "x de",
    "l'or, l'or; l'OR", "الدين العمومي", "la " * 300, "banque" * 100, " de  la  banque  de  la",
]


@pytest.mark.parametrize("texts, characters", [(64, 1 << 18), (3, 17), (1, 1)])
def test_counts_of_grams_by_a_slow_walk(monkeypatch, texts, characters):
    monkeypatch.setattr(topics, "TEXTS", texts)
    monkeypatch.setattr(topics, "CHARACTERS", characters)
    examples = plain_grams("Le taux de la banque: l'or de 1 rate_1 الدين العمومي the \U0001d538\U0001d539 of the rates")
    names = [(kind, g) for kind in ("word", "character") for g in sorted(examples[kind])]
    grams = topics._Grams({kind: {g: k for k, (x, g) in enumerate(names) if x == kind} for kind in ("word", "character")})
    got = [c.tolist() for some in topics._together([t.lower() for t in ODD]) for c in grams.counts(some)]
    assert got == [[plain_grams(t)[kind][g] for kind, g in names] for t in ODD]

"""A topic classifier, and similarity to the descriptions of indicators, on word and character n-grams.

Both weigh a text by the grams of a small vocabulary (that of the examples). The examples are counted by joins and aggregations; a text
of the corpus is then one product of its own grams with that matrix, batch by batch in Arrow, after one shuffle that spreads the texts: as rows, three
grams a character cost 93 s over the 10,000 documents that take a few seconds this way. Grams are found by walking a tree of their letters from all
places of many texts at once. No vocabulary of the corpus is built.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessellis.operators.segment import PARTS

SEEDS = {
    "inflation": [
        "Inflation reached five percent over the year.", "Consumer prices rose again in March.", "The annual inflation of food prices slowed.",
        "L'inflation recule en glissement annuel.", "Les prix à la consommation progressent de nouveau.", "La hausse des prix de l'alimentation s'accélère.",
        "بلغ التضخم السنوي خمسة بالمائة.", "تباطأت أسعار الاستهلاك في مارس.", "ارتفاع أسعار المواد الغذائية.",
    ],
    "gdp_growth": [
        "Gross domestic product grew by two percent.", "Economic growth slowed in the third quarter.", "Real GDP shrank and the economy entered a recession.",
        "La croissance économique ralentit au troisième trimestre.", "Le produit intérieur brut a gagné deux pour cent.", "Le PIB réel recule et l'activité se contracte.",
        "تباطأ النمو الاقتصادي في الربع الثالث.", "زاد الناتج المحلي الإجمالي الحقيقي.", "انكمش الاقتصاد هذا العام.",
    ],
    "unemployment": [
        "The unemployment rate fell to eight percent.", "Joblessness among graduates rose and employment in services fell.", "More people were out of work.",
        "Le taux de chômage a baissé à huit pour cent.", "Les emplois créés dans l'industrie réduisent le chômage.", "Le chômage des diplômés augmente.",
        "تراجعت نسبة البطالة إلى ثمانية بالمائة.", "زادت بطالة خريجي الجامعات.", "عدد العاطلين عن العمل.",
    ],
    "interest_rate": [
        "The central bank raised its policy rate by half a point.", "The key interest rate was cut.", "Monetary policy rates stay on hold.",
        "La banque centrale relève son taux directeur.", "Le taux d'intérêt principal a été réduit.", "Les taux de la politique monétaire restent inchangés.",
        "رفع البنك المركزي سعر الفائدة الرئيسي.", "تم خفض سعر الفائدة.", "الإبقاء على نسبة الفائدة المديرية.",
    ],
    "public_debt": [
        "Public debt climbed to eighty percent of output.", "Government debt service weighs on the treasury.", "The stock of sovereign debt fell.",
        "La dette publique atteint quatre-vingts pour cent du PIB.", "Le service de la dette de l'État s'alourdit.", "L'encours de la dette souveraine diminue.",
        "ارتفع الدين العمومي إلى ثمانين بالمائة.", "خدمة الدين الحكومي.", "تراجع حجم الدين السيادي.",
    ],
    "budget_deficit": [
        "The budget deficit narrowed as revenue rose.", "The fiscal gap widened with subsidies.", "The government balance shows a deficit.",
        "Le déficit budgétaire se réduit grâce aux recettes fiscales.", "Le solde budgétaire de l'État est négatif.", "Les subventions creusent le déficit public.",
        "تقلص عجز الميزانية بفضل الموارد الجبائية.", "اتسع العجز المالي للدولة.", "رصيد الميزانية سلبي.",
    ],
    "trade_balance": [
        "The trade deficit widened.", "The balance of trade in goods improved.", "The current account gap reached a record.",
        "Le déficit commercial se creuse.", "La balance commerciale des biens s'améliore.", "Le solde des échanges extérieurs est déficitaire.",
        "اتسع العجز التجاري.", "تحسن الميزان التجاري للسلع.", "رصيد المبادلات الخارجية.",
    ],
    "exports": [
        "Exports of goods increased.", "Olive oil was exported in larger volumes.", "Sales abroad of textiles fell and exports weakened.",
        "Les exportations de biens ont augmenté.", "Les ventes d'huile d'olive à l'étranger progressent.", "Les exportations du textile fléchissent.",
        "زادت صادرات السلع.", "تصدير زيت الزيتون.", "تراجعت الصادرات الصناعية.",
    ],
    "imports": [
        "Imports of energy increased.", "More cereals were imported.", "Purchases abroad of machinery fell and imports slowed.",
        "Les importations d'énergie ont augmenté.", "Les achats de céréales à l'étranger progressent.", "Les importations de machines fléchissent.",
        "زادت واردات الطاقة.", "استيراد الحبوب.", "تراجعت الواردات من الآلات.",
    ],
    "fdi": [
        "Foreign direct investment rose by ten percent.", "Investors from abroad opened plants.", "FDI inflows into industry fell.",
        "Les investissements directs étrangers progressent de dix pour cent.", "Les flux d'IDE vers l'industrie reculent.", "Des investisseurs étrangers ouvrent des usines.",
        "زاد الاستثمار الأجنبي المباشر.", "تدفقات الاستثمارات الخارجية.", "تراجع المستثمرين الأجانب.",
    ],
    "exchange_rate": [
        "The dinar lost value against the euro.", "The exchange rate of the currency was stable.", "The dollar appreciated on the foreign exchange market.",
        "Le dinar se déprécie face à l'euro.", "Le taux de change de la monnaie est stable.", "Le dollar s'apprécie sur le marché des changes.",
        "تراجع الدينار مقابل اليورو.", "استقر سعر صرف العملة.", "ارتفع الدولار في سوق الصرف.",
    ],
    "tourism_revenue": [
        "Tourism receipts grew over the summer.", "Earnings from tourists exceeded those of last season.", "Revenue of hotels and tourism fell.",
        "Les recettes touristiques augmentent pendant l'été.", "Les revenus du tourisme dépassent ceux de la saison passée.", "Les recettes des hôtels reculent.",
        "زادت عائدات السياحة خلال الصيف.", "مداخيل القطاع السياحي.", "تراجعت إيرادات الفنادق السياحية.",
    ],
    "other": [
        "The museum opens on Sunday.", "A recipe with apples and sugar.", "The train to the coast was late.",
        "Le match a eu lieu hier soir.", "Une promenade dans la forêt.", "Le concert commence à vingt heures.",
        "يفتح المتحف يوم الأحد.", "وصفة بالتفاح والسكر.", "تأخر القطار هذا الصباح.",
    ],
}

# The descriptions of indicators.
DESCRIPTIONS = {
    "gdp_growth": "economic growth gross domestic product GDP growth real GDP PIB croissance économique الناتج المحلي الإجمالي النمو الاقتصادي",
    "inflation": "inflation consumer prices CPI price level hausse des prix indice des prix التضخم أسعار المستهلك",
    "interest_rate": "central bank policy interest rate key rate taux directeur taux d'intérêt سعر الفائدة البنك المركزي",
    "unemployment": "unemployment jobless rate labour market chômage taux de chômage البطالة سوق العمل",
    "public_debt": "public government debt sovereign debt dette publique الدين العمومي الدين الحكومي",
    "fiscal_deficit": "budget fiscal deficit government balance déficit budgétaire solde public عجز الميزانية",
    "trade_balance": "trade balance current account merchandise deficit balance commerciale déficit commercial الميزان التجاري العجز التجاري",
    "exports": "exports exported goods and services exportations صادرات الصادرات",
    "imports": "imports imported goods and services importations واردات الواردات",
    "fdi": "foreign direct investment FDI investissement direct étranger IDE الاستثمار الأجنبي المباشر",
    "investment": "investment capital formation investissement استثمار تكوين رأس المال",
    "tourism_revenue": "tourism receipts tourism revenues recettes touristiques revenus touristiques عائدات السياحة الإيرادات السياحية",
    "tourism": "tourism visitors arrivals nights tourisme touristes nuitées سياحة سياح ليالي",
    "exchange_rate": "exchange rate currency appreciation depreciation taux de change devise سعر الصرف العملة",
    "industrial_production": "industrial production manufacturing output production industrielle industrie الإنتاج الصناعي",
    "remittances": "worker remittances transfers from abroad transferts des migrants تحويلات العاملين",
}

#: Grams kept of each kind, the most frequent of the examples.
WORD_GRAMS, CHARACTER_GRAMS = 12_000, 18_000


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(label, text) for label, texts in SEEDS.items() for text in texts], "label string, text string")


def descriptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DESCRIPTIONS.items()), "code string, text string")


def words_of(low: str) -> list[str]:
    """Words of two characters or more of a text in lower case."""
    return re.findall(r"\w{2,}", low)


def cut(piece: str) -> Counter:
    """The 3 to 5 characters in a row of a piece between blanks, the blanks around it included."""
    padded = f" {piece} "
    return Counter(padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1))


def _grams(rows: DataFrame, key: str) -> DataFrame:
    """(key, kind, gram, n) of examples: words and pairs of them, characters within pieces."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch[key], batch["text"]):
                low = (text or "").lower()
                words = words_of(low)
                out += [(name, "word", g, n) for g, n in Counter([*words, *map(" ".join, zip(words, words[1:]))]).items()]
                out += [(name, "character", g, n) for g, n in sum(map(cut, low.split()), Counter()).items()]
            yield pd.DataFrame(out, columns=[key, "kind", "gram", "n"])

    return rows.select(key, "text").mapInPandas(counted, f"`{key}` {rows.schema[key].dataType.simpleString()}, kind string, gram string, n long")


def _weighed(examples: DataFrame, key: str) -> DataFrame:
    """(key, kind, gram, idf, w): the damped, rarity-weighted grams of the examples (few), of length one by kind."""
    total = examples.count()
    counted = _grams(examples, key)
    known = counted.groupBy("kind", "gram").agg((F.log(F.lit(total + 1) / (F.count("*") + 1)) + 1).alias("idf"), F.sum("n").alias("_all"))
    known = known.withColumn("_nr", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("_all"), F.length("gram"), "gram")))
    known = known.filter(F.col("_nr") <= F.when(F.col("kind") == "word", WORD_GRAMS).otherwise(CHARACTER_GRAMS)).drop("_all", "_nr")
    raw = counted.join(known, ["kind", "gram"]).withColumn("_raw", (1 + F.log("n")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(W.partitionBy(key, "kind")))
    return raw.select(key, "kind", "gram", "idf", (F.col("_raw") / length).alias("w"))


#: Texts and characters that are looked through at once; a longer text is alone, and its places are walked in parts of so many.
TEXTS, CHARACTERS = 64, 1 << 18


class _Tree:
    """Strings by their letters: ``step`` leads from a node by the next letter, 0 being no node (and the root, to which nothing leads)."""

    def __init__(self, strings: list[str], ids: list[int], letters: np.ndarray) -> None:
        nodes = {"": 0}
        for s in strings:
            for n in range(1, len(s) + 1):
                nodes.setdefault(s[:n], len(nodes))
        self.step = np.zeros((len(nodes), int(letters.max(initial=0)) + 1), np.int32)
        for s, node in nodes.items():
            if s:
                self.step[nodes[s[:-1]], letters[ord(s[-1])]] = node
        self.id = np.full(len(nodes), -1)
        self.id[[nodes[s] for s in strings]] = ids

    def walk(self, text: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, ids) of what begins at the places ``at`` of ``text``, by length; the id is -1 where only something longer is known."""
        node, length = np.zeros(len(at), np.int32), 0
        while len(at):
            node = self.step[node, text[at + length]]
            at, node, length = at[node > 0], node[node > 0], length + 1
            yield length, at, self.id[node]


class _Grams:
    """The known grams of texts, found in many texts at once."""

    def __init__(self, known: dict[str, dict[str, int]]) -> None:
        every = "".join(map(chr, range(sys.maxunicode + 1)))
        self.word = np.zeros(len(every), bool)
        self.word[[ord(c) for c in re.findall(r"\w", every)]] = True
        used = sorted(set("".join([*known["word"], *known["character"]])) - {" "})
        self.letters = np.zeros(len(every), np.uint16)  # 0: in no gram
        self.letters[[ord(c) for c in used]] = np.arange(2, len(used) + 2)
        self.letters[[k for k, c in enumerate(every) if c.isspace()]] = 1
        self.size = sum(map(len, known.values()))
        pairs = {tuple(g.split(" ")): k for g, k in known["word"].items() if " " in g}
        names = sorted({g for g in known["word"] if " " not in g}.union(*pairs))
        number = {g: k for k, g in enumerate(names)}
        self.characters = _Tree(list(known["character"]), list(known["character"].values()), self.letters)
        self.names = _Tree(names, list(range(len(names))), self.letters)
        self.single = np.array([known["word"].get(g, -1) for g in names], int)
        keyed = sorted((number[a] * len(names) + number[b], k) for (a, b), k in pairs.items())
        self.pair, self.pair_id = np.array([x for x, _ in keyed], int), np.array([k for _, k in keyed], int)

    def counts(self, lows: list[str]) -> np.ndarray:
        """How often each text, in lower case, has each known gram."""
        whole = "".join(f" {low} " for low in lows)  # two blanks part texts; no known gram has two, or one inside a piece
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        text, word = np.append(self.letters[points], np.uint16(0)), self.word[points]
        ends = np.cumsum([len(low) + 2 for low in lows])
        found = []

        def keep(at: np.ndarray, ids: np.ndarray) -> None:
            found.append(np.searchsorted(ends, at[ids >= 0], side="right") * self.size + ids[ids >= 0])

        for first in range(0, len(points), CHARACTERS):
            for _, at, ids in self.characters.walk(text, np.arange(first, min(first + CHARACTERS, len(points)))):
                keep(at, ids)
        edges = np.flatnonzero(np.diff(word))  # texts begin and end with a blank
        starts, lengths = edges[::2] + 1, edges[1::2] - edges[::2]
        starts, lengths = starts[lengths > 1], lengths[lengths > 1]
        name = np.full(len(starts), -1)
        for length, at, ids in self.names.walk(text, starts):
            here = np.searchsorted(starts, at)
            name[here[lengths[here] == length]] = ids[lengths[here] == length]
        keep(starts[name >= 0], self.single[name[name >= 0]])
        if len(self.pair):
            both = np.flatnonzero((name[:-1] >= 0) & (name[1:] >= 0))
            both = both[np.searchsorted(ends, starts[both], side="right") == np.searchsorted(ends, starts[both + 1], side="right")]
            asked = name[both] * len(self.single) + name[both + 1]
            place = np.minimum(np.searchsorted(self.pair, asked), len(self.pair) - 1)
            keep(starts[both], np.where(self.pair[place] == asked, self.pair_id[place], -1))
        return np.bincount(np.concatenate(found), minlength=len(lows) * self.size).reshape(len(lows), self.size)


def _together(lows: list[str]) -> Iterator[list[str]]:
    """``lows`` in order, as many at once as are looked through together."""
    some, size = [], 0
    for low in lows:
        if some and (len(some) == TEXTS or size + len(low) > CHARACTERS):
            yield some
            some, size = [], 0
        some.append(low)
        size += len(low)
    if some:
        yield some


def _products(rows: DataFrame, keys: list[str], weights: DataFrame, size: int) -> DataFrame:
    """(keys, kinds, products): the products of each text with ``size`` weights a gram, each kind of grams of length one.

    ``weights`` (kind, gram, idf, weights) is no longer than the two limits above together, hence read by every task. A table can be a single
    file of one row group, that is one task, so texts pass a shuffle before their grams are counted.
    """
    known = weights.select("kind", "gram", "idf", "weights").collect()  # at most WORD_GRAMS + CHARACTER_GRAMS rows
    grams = _Grams({kind: {r["gram"]: k for k, r in enumerate(known) if r["kind"] == kind} for kind in ("word", "character")})
    of_word = np.array([r["kind"] == "word" for r in known], dtype=bool)
    idf, matrix = np.array([r["idf"] for r in known], dtype=float), np.array([r["weights"] for r in known], dtype=float).reshape(len(known), size)
    shared = rows.sparkSession.sparkContext.broadcast((grams, of_word, idf, matrix))

    @F.pandas_udf("kinds int, products array<double>")
    def product(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        grams, of_word, idf, matrix = shared.value

        def scored(counts: np.ndarray) -> tuple[int, list[float]]:
            kinds, total = 0, np.zeros(size)
            for kind in (of_word, ~of_word):
                at = np.flatnonzero((counts > 0) & kind)
                if len(at):
                    w = (1 + np.log(counts[at])) * idf[at]
                    kinds, total = kinds + 1, total + w @ matrix[at] / np.sqrt(w @ w)
            return kinds, total.tolist()

        for batch in batches:
            lows = [(t or "").lower() for t in batch]
            yield pd.DataFrame([scored(c) for some in _together(lows) for c in grams.counts(some)], columns=["kinds", "products"])

    parts = PARTS * rows.sparkSession.sparkContext.defaultParallelism
    spread = rows.select(*keys, F.col("text").alias("_text")).repartition(parts, *keys, "_text")
    return spread.select(*keys, product(F.col("_text")).alias("_x")).select(*keys, "_x.*")


def train(examples: DataFrame, c: float = 4.0) -> DataFrame:
    """The model of labelled examples (few) as a table, to be written and read like any other: kind, gram, idf, and the weights of the labels in order.

    A logistic regression with classes of equal weight. The row of kind "intercept" holds the intercepts, the row of kind "labels" names them.
    """
    spark = examples.sparkSession
    rows = examples.select("label", "text").coalesce(1).withColumn("_id", F.monotonically_increasing_id()).persist()
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    labels, total = sorted(sizes), sum(sizes.values())
    weighed = _weighed(rows.select("_id", "text"), "_id").persist()
    grams = weighed.select("kind", "gram", "idf").distinct().withColumn("id", F.row_number().over(W.orderBy("kind", "gram")) - 1).persist()
    width = grams.count()
    vector = F.udf(lambda pairs: Vectors.sparse(width, sorted((p["id"], p["w"]) for p in pairs)), VectorUDT())
    known = weighed.join(grams, ["kind", "gram"]).groupBy("_id").agg(F.collect_list(F.struct("id", "w")).alias("_pairs"))
    target = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
    even = F.try_element_at(F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, total / len(sizes) / n))), F.col("label"))
    features = known.join(rows, "_id").select(vector("_pairs").alias("features"), target.cast("double").alias("target"), even.alias("even")).coalesce(1).persist()
    fitted = LogisticRegression(labelCol="target", weightCol="even", family="multinomial", regParam=1 / (c * total), standardization=False, maxIter=100).fit(features)
    matrix = fitted.coefficientMatrix.toArray()
    learned = spark.createDataFrame([(k, matrix[:, k].tolist()) for k in range(width)], "id int, weights array<double>")
    model = grams.join(learned, "id").select("kind", "gram", "idf", "weights")
    ends = spark.createDataFrame([("intercept", "", 0.0, fitted.interceptVector.tolist())] + [("labels", name, float(k), []) for k, name in enumerate(labels)], "kind string, gram string, idf double, weights array<double>")
    return model.unionByName(ends)


def predict(model: DataFrame, rows: DataFrame, keys: list[str], best: int = 3) -> DataFrame:
    """(keys, rank, topic, probability): the most probable topics of every text; none for a null or blank one. Equal ones by name."""
    ends = model.filter("kind IN ('intercept', 'labels')").collect()
    labels = [r["gram"] for r in sorted((r for r in ends if r["kind"] == "labels"), key=lambda r: r["idf"])]
    start = next(r["weights"] for r in ends if r["kind"] == "intercept")
    texts = rows.filter(F.col("text").rlike(r"(?U)\S"))
    text = texts.select(*keys, F.col("text")) if "text" not in keys else texts.select(*keys)
    scored = _products(text, keys, model.filter("kind IN ('word', 'character')"), len(labels))
    logits = F.array(*(F.get("products", F.lit(k)) + b for k, b in enumerate(start)))
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    scored = scored.select(*keys, powers.alias("_e")).withColumn("_all", F.aggregate("_e", F.lit(0.0), lambda s, x: s + x))
    pairs = F.array(*(F.struct((-F.round(F.get("_e", F.lit(k)) / F.col("_all"), 4)).alias("p"), F.lit(name).alias("topic")) for k, name in enumerate(labels)))
    return scored.select(*keys, F.posexplode(F.slice(F.array_sort(pairs), 1, best)).alias("rank", "_b")).select(*keys, "rank", "_b.topic", (-F.col("_b.p")).alias("probability"))


def similarity(rows: DataFrame, key: str, described: DataFrame) -> DataFrame:
    """(key, code, score): the cosine of every text of five characters or more (trimmed) and every description (few); zero if they share no gram."""
    codes = sorted(r["code"] for r in described.select("code").collect())
    weighed = _weighed(described.select("code", "text"), "code")
    arrays = F.array(*(F.coalesce(F.sum(F.when(F.col("code") == c, F.col("w"))), F.lit(0.0)) for c in codes))
    weights = weighed.groupBy("kind", "gram").agg(F.first("idf").alias("idf"), arrays.alias("weights")).persist()
    texts = rows.select(key, "text").filter(F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")) >= 5)
    scored = _products(texts, [key], weights, len(codes))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, codes)).alias("code"), F.col("products").alias("dot")))
    length = F.sqrt(F.greatest(F.col("kinds"), F.lit(1))) * F.sqrt(F.lit(2.0))
    return scored.select(key, length.alias("_length"), each.alias("x")).select(key, "x.code", F.round(F.col("x.dot") / F.col("_length"), 4).alias("score"))

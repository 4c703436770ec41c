"""Reading level of the prose in notebooks, on the scale of graded anchor texts.

Notebooks are decoded once into the words of their paragraphs. The language of a paragraph comes from character statistics: trigram
models of the declared languages, fitted on a bounded sample and refitted on their own decisions, since the declarations may mislead;
the anchors tell which of them is the language of the scale. Words of the corpus in that language are ranked by frequency. The coverage rank of a
text is the size of the smallest frequency-ranked vocabulary that covers a fixed share of its words. Coverage ranks at two shares and
the complexity of sentences (words per sentence, letters per word) are calibrated on the anchors in SQL. Since the level of the greater part of
a document's prose is asked for, each paragraph gets the nearest level and the words of the paragraphs vote.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.notebooks import TEXT, cells
from tracemill.session import materialize

#: The most frequent words, up to so many and so many bytes, are broadcast; ranks of all others come from a join.
HEAD_WORDS, HEAD_BYTES = 65_536, 8 << 20
#: Labelled documents the language models are fitted on, the letters such a document may have, and how often they are refitted.
SAMPLE_DOCUMENTS, SAMPLE_LETTERS, ROUNDS = 4_000, 16_384, 2
#: A language whose model describes the anchors nearly as well as the best one (in nats per trigram) is that of the anchors.
NEAR = 1.0
#: Shares of a text's words that its vocabularies must cover.
SHARES = (0.6, 0.8)
FEATURES = ("letters", "sentence", "rank_a", "rank_b")
#: Words of prose a document needs.
LEAST_WORDS = 40
_CACHED, _FLUSHED = 200_000, 8 << 20

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_END = re.compile(r"[.!?。！？]+[\"')\]]*(?=\s|$)|[。！？]")
_MARKUP = re.compile(r"!\[[^\]]*\]\([^)]*\)|<[^<>]*>|`[^`\n]*`|\bhttps?://\S+|\bdata:[\w/+.-]+;base64,\S+|\]\([^)\s]*\)|\$\$.*?\$\$", re.S)
_LEAD = re.compile(r"^\s*(?:[-*+>]|\d+[.)])\s+")


def paragraphs(text: str) -> Iterator[str]:
    """The paragraphs of a text cell without markup, headings, tables and code."""
    for block in re.split(r"\n\s*\n", _MARKUP.sub(" ", text)):
        lines = []
        for line in block.split("\n"):
            bare = line.strip()
            if bare.startswith(("#", "|", "```", "    ", "$$")) or set(bare) <= set("=-*_ "):
                continue
            lines.append(_LEAD.sub("", line))
        joined = "\n".join(lines).strip()
        if joined:
            yield joined


def prose(text: str | None, nb_format: str | None) -> list[tuple[list[str], int]]:
    """(words in lower case, number of sentence ends) of each paragraph of a notebook's text cells, in any language."""
    found = []
    for kind, part in cells(text, nb_format):
        if kind != TEXT:
            continue
        for paragraph in paragraphs(part):
            words = _WORD.findall(paragraph.lower())
            ends = len(_END.findall(paragraph))
            # a title or a label is no prose
            if words and (len(words) >= 4 or ends):
                found.append((words, ends))
    return found


PROSE = "id bigint, anchor boolean, label string, parts array<struct<words: string, ends: int>>"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("words", pa.string()), ("ends", pa.int32())]))
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            parts = [[{"words": " ".join(words), "ends": ends} for words, ends in prose(text, nb_format)] for text, nb_format in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(parts, kind)], ["id", "anchor", "label", "parts"])


# -- language --------------------------------------------------------------------------------------------------------

def _trigrams(word: str) -> list[str]:
    marked = f" {word} "
    return [marked[i:i + 3] for i in range(len(marked) - 2)]


class LanguageModel:
    """Log-likelihoods of character trigrams under each language, and a flat one that stands for none of them."""

    def __init__(self, counts: dict[str, Counter[str]], anchors: Counter[str]):
        import numpy as np

        names = sorted(counts)
        grams = sorted(set().union(*counts.values()))
        self.index = {g: k for k, g in enumerate(grams)}
        table = np.array([[counts[n][g] for n in names] for g in grams] + [[0] * len(names)], np.float64).reshape(len(grams) + 1, len(names)) + 0.5
        logs = np.log(table / table.sum(axis=0))
        # none of the languages: somewhat likelier only where nearly all trigrams are unseen
        self.table = np.hstack([logs, np.full((len(grams) + 1, 1), 0.9 * logs[-1].min())])
        fit = sum(n * self.table[self.index.get(g, -1)] for g, n in anchors.items())
        self.names, self.own = [*names, ""], fit >= fit.max() - NEAR * sum(anchors.values()) if anchors else np.ones(len(names) + 1, bool)
        self.own[-1] = False
        self.cached: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.names)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cached"} | {"cached": {}}

    def best(self, texts: list[list[str]]):
        """The number of the likeliest language of each text, a non-empty list of words; words already seen aren't cut up again."""
        import numpy as np

        if len(self.cached) > _CACHED:
            self.cached.clear()
        cached, index, flat = self.cached, self.index, []
        for words in texts:
            for word in words:
                k = cached.get(word)
                if k is None:
                    k = cached[word] = len(cached)
                    if k >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[k] = self.table[[index.get(g, -1) for g in _trigrams(word)]].sum(axis=0)
                flat.append(k)
        starts = np.cumsum([0, *(len(words) for words in texts)])[:-1]
        return np.add.reduceat(self.rows[flat], starts, axis=0).argmax(axis=1)


def _count(texts: list[list[str]]) -> Counter[str]:
    words = Counter(w for words in texts for w in words)
    total: Counter[str] = Counter()
    for word, n in words.items():
        for gram in _trigrams(word):
            total[gram] += n
    return total


def fit_languages(labelled: list[tuple[str, list[list[str]]]], anchors: list[list[str]]) -> LanguageModel:
    """Models of the labels (each with its texts), refitted on what they decide; the anchors are a language of their own."""
    seed = _count(anchors)
    groups: dict[str, list[list[str]]] = defaultdict(list)
    for label, texts in labelled:
        groups[label] += texts
    texts = [t for group in groups.values() for t in group]
    model = LanguageModel({"anchors": seed} | {label: _count(group) for label, group in groups.items()}, seed)
    for _ in range(ROUNDS if texts else 0):
        decided: dict[str, list[list[str]]] = defaultdict(list)
        for text, k in zip(texts, model.best(texts).tolist(), strict=True):
            decided[model.names[k]].append(text)
        decided.pop("", None)
        model = LanguageModel({"anchors": seed} | {label: _count(group) + (seed if label == "anchors" else Counter()) for label, group in decided.items()}, seed)
    return model


def _fitted(spark, rows: DataFrame) -> LanguageModel:
    """The language models from about SAMPLE_DOCUMENTS labelled documents at most, picked by the hash of their ids, and the anchors."""
    label = F.lower(F.regexp_extract("label", "^([A-Za-z]+)", 1))
    letters = F.aggregate("parts", F.lit(0), lambda n, p: n + F.length(p["words"]))
    sample = rows.filter("NOT anchor").withColumn("label", label).filter((F.col("label") != "") & (F.col("label") != "und") & (letters > 0) & (letters <= SAMPLE_LETTERS))
    # one of so many by the hash of the id, so that about SAMPLE_DOCUMENTS at most come from any number
    one_of = max(1, -(-sample.count() // SAMPLE_DOCUMENTS))
    sample = sample.filter(F.pmod(F.xxhash64("id"), F.lit(one_of)) == 0).select("label", F.transform("parts", lambda p: p["words"]).alias("texts")).collect()
    graded = rows.filter("anchor").orderBy("id").limit(SAMPLE_DOCUMENTS).select(F.transform("parts", lambda p: F.substring(p["words"], 1, SAMPLE_LETTERS)).alias("texts")).collect()
    return fit_languages([(r.label, [t.split() for t in r.texts]) for r in sample], [t.split() for r in graded for t in r.texts])


# -- vocabulary ------------------------------------------------------------------------------------------------------

def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str], int]]:
    """(row, part, words, ends) of every paragraph of a batch."""
    for row, parts in enumerate(batch.column(3).to_pylist()):
        for k, part in enumerate(parts or ()):
            yield row, k, part["words"].split(), part["ends"]


def _chosen(batch: pa.RecordBatch, model: LanguageModel) -> list[tuple[int, list[str], int, bool]]:
    """(row, words, ends, whether in the anchors' language) of every paragraph; those of anchors are."""
    found = list(_texts(batch))
    if not found:
        return []
    anchor = batch.column(1).to_pylist()
    own = model.own[model.best([words for _, _, words, _ in found])].tolist()
    return [(row, words, ends, mine or anchor[row]) for (row, _, words, ends), mine in zip(found, own, strict=True)]


def _word_counts(rows: DataFrame, shared) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts, size = shared.value, Counter(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for _, words, _, mine in _chosen(batch.slice(start, 256), model):
                    if mine:
                        before = len(counts)
                        counts.update(words)
                        if len(counts) > before:
                            size += sum(map(len, words))
                # what has been counted so far leaves before it grows too large; the next grouping adds it up
                if size > _FLUSHED:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                    counts, size = Counter(), 0
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return rows.filter("NOT anchor").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def ranked_vocabulary(counts: DataFrame) -> DataFrame:
    """word, n, rank of (word, n); equally frequent words share the rank of the last of them."""
    # ranks come from how many words have each count, of which there are few, not from ordering all words in one task
    by_count = counts.groupBy("n").agg(F.count("*").alias("words"))
    ranks = by_count.select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("rank"))
    return counts.join(ranks, "n").select("word", "n", "rank")


def _head(vocabulary: DataFrame) -> dict[str, int]:
    """The first words of the vocabulary with their ranks: no word beyond them has a lower rank."""
    head, size = {}, 0
    # a rank counts the words up to it, so no more than HEAD_WORDS pass
    for row in vocabulary.filter(F.col("rank") <= HEAD_WORDS).orderBy("rank", F.length("word"), "word").select(F.when(F.length("word") <= HEAD_BYTES // 64, F.col("word")).alias("word"), "rank").toLocalIterator():
        size += len((row.word or "").encode()) + 8
        if row.word is None or size > HEAD_BYTES:
            break
        head[row.word] = row.rank
    return head


# -- features --------------------------------------------------------------------------------------------------------

_PART = "struct<words: int, letters: double, sentence: double, at_a: int, at_b: int, rank_a: bigint, rank_b: bigint, rare: array<string>>"
PROFILE = f"id bigint, anchor boolean, own bigint, other bigint, words bigint, parts array<{_PART}>"


def _measured(rows: DataFrame, shared) -> DataFrame:
    """Letters in and outside the anchors' language, and the features of each paragraph and, in front, of the whole text.

    A rank that lies beyond the broadcast words is left open: ``at`` tells which of the ranks of ``rare`` it is.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import ceil, log

        model, head = shared.value
        get = head.get

        def features(words: list[str], sentences: int) -> dict:
            known = sorted(r for r in map(get, words) if r is not None)
            part = {"words": len(words), "letters": sum(map(len, words)) / len(words), "sentence": log(len(words) / sentences), "rare": None}
            for share, name in zip(SHARES, "ab", strict=True):
                at = ceil(share * len(words)) - 1
                part[f"rank_{name}"], part[f"at_{name}"] = (known[at], None) if at < len(known) else (None, at - len(known))
                if at >= len(known) and part["rare"] is None:
                    part["rare"] = [w for w in words if get(w) is None]
            return part

        fields = [("words", pa.int32()), ("letters", pa.float64()), ("sentence", pa.float64()), ("at_a", pa.int32()), ("at_b", pa.int32()), ("rank_a", pa.int64()), ("rank_b", pa.int64()), ("rare", pa.list_(pa.string()))]
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                letters = [[0, 0] for _ in range(part.num_rows)]
                texts: list[list[tuple[list[str], int]]] = [[] for _ in range(part.num_rows)]
                for row, words, ends, mine in _chosen(part, model):
                    letters[row][not mine] += sum(map(len, words))
                    if mine:
                        texts[row].append((words, max(1, ends)))
                parts = [[features([w for words, _ in own for w in words], sum(n for _, n in own)), *(features(*x) for x in own)] if own else [] for own in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([n[k] for n in letters], pa.int64()) for k in (0, 1)), pa.array([sum(len(w) for w, _ in own) for own in texts], pa.int64()),
                                                  pa.array(parts, pa.list_(pa.struct(fields)))], ["id", "anchor", "own", "other", "words", "parts"])

    return rows.mapInArrow(measure, PROFILE)


def _profiles(rows: DataFrame, vocabulary: DataFrame, shared) -> DataFrame:
    """Profiles with every rank known: those beyond the broadcast words come from a join with the vocabulary."""
    rows = materialize(_measured(rows, shared).withColumn("row", F.monotonically_increasing_id()), "profiles")
    open_parts = rows.select("row", F.posexplode("parts").alias("k", "p")).filter("p.rare IS NOT NULL")
    rare = open_parts.select("row", "k", F.explode("p.rare").alias("word")).join(vocabulary.select("word", "rank"), "word")
    ranks = rare.groupBy("row", "k").agg(F.array_sort(F.collect_list("rank")).alias("ranks")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "ranks"))).alias("found"))

    def rank(part: Column, k: Column, name: str) -> Column:
        return F.coalesce(part[f"rank_{name}"], F.get(F.element_at("found", k), part[f"at_{name}"])).cast("double")

    parts = F.transform("parts", lambda p, k: F.struct(p["words"].alias("words"), p["letters"].alias("letters"), p["sentence"].alias("sentence"), F.ln(rank(p, k, "a")).alias("rank_a"), F.ln(rank(p, k, "b")).alias("rank_b")))
    return rows.join(ranks, "row", "left").select("id", "anchor", "own", "other", "words", parts.alias("all")).select("id", "anchor", "own", "other", "words", F.get("all", F.lit(0)).alias("whole"), F.slice("all", 2, 1 << 30).alias("parts"))


def calibration(anchor_profiles: DataFrame) -> DataFrame:
    """One row: an array of (level, mean and pooled deviation of each feature) from the graded anchors' paragraphs."""
    anchor_profiles.createOrReplaceTempView("_anchor_profiles")
    means = ", ".join(f"sum(p.words * p.{f}) / sum(p.words) AS m_{f}, sum(p.words * p.{f} * p.{f}) / sum(p.words) AS q_{f}" for f in FEATURES)
    pooled = ", ".join(f"sqrt(greatest(avg(q_{f} - m_{f} * m_{f}) OVER (), 1e-6)) AS d_{f}" for f in FEATURES)
    fields = ", ".join(f"'m_{f}', m_{f}, 'd_{f}', d_{f}" for f in FEATURES)
    return anchor_profiles.sparkSession.sql(f"""
        WITH parts AS (SELECT id AS level, explode(parts) AS p FROM _anchor_profiles),
        levels AS (SELECT level, {means} FROM parts GROUP BY level),
        spread AS (SELECT *, {pooled} FROM levels)
        SELECT array_sort(collect_list(named_struct('level', level, {fields}))) AS levels FROM spread""")


def nearest_level(part: Column, levels: Column) -> Column:
    """The level whose calibrated features are nearest, in pooled deviations; the lower one of a tie."""

    def distance(level: Column) -> Column:
        total = F.lit(0.0)
        for f in FEATURES:
            z = (part[f] - level[f"m_{f}"]) / level[f"d_{f}"]
            total = total + z * z
        return F.struct(total.alias("distance"), level["level"].alias("level"))

    return F.array_min(F.transform(levels, distance))["level"]


def reading_levels(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, level, words, coverage: documents whose text cells are mainly in the anchors' language (by letters) and hold LEAST_WORDS words of prose.

    The level is the one with the most words over the document's paragraphs, the higher one of a tie; ``coverage`` is the coverage rank of the
    whole document at the larger share. Null and empty texts, texts without prose and other languages have no row. A column ``lang``
    helps to fit the language models where there is one and decides nothing for its row. Repeated ids give repeated rows. Without
    anchors there is no scale and the result is empty.
    """
    label = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.lit(False).alias("anchor"), label.alias("label"), "text", "nb_format")
    graded = anchors.filter("level IS NOT NULL").select(F.col("level").cast("bigint").alias("id"), F.lit(True).alias("anchor"), F.lit(None).cast("string").alias("label"), "text", F.lit("none").alias("nb_format"))
    decoded = materialize(rows.unionByName(graded).mapInArrow(_decode, PROSE).filter("size(parts) > 0"), "prose")
    spark = docs.sparkSession
    model = _fitted(spark, decoded)
    vocabulary = materialize(ranked_vocabulary(materialize(_word_counts(decoded, spark.sparkContext.broadcast(model)), "words")), "vocabulary")
    profiles = materialize(_profiles(decoded, vocabulary, spark.sparkContext.broadcast((model, _head(vocabulary)))), "ranked")
    scale = calibration(profiles.filter("anchor"))
    profiles = profiles.filter("NOT anchor").filter((F.col("own") > F.col("other")) & (F.col("words") >= LEAST_WORDS))
    scored = profiles.withColumn("levels", scale.scalar()).filter(F.size("levels") > 0)
    votes = scored.withColumn("votes", F.transform("parts", lambda p: F.struct(nearest_level(p, F.col("levels")).alias("level"), p["words"].alias("words"))))
    totals = F.transform(F.transform("levels", lambda x: x["level"]), lambda n: F.struct(
        F.aggregate(F.filter("votes", lambda v: v["level"] == n), F.lit(0), lambda a, v: a + v["words"]).alias("words"), n.alias("level")))
    return votes.select(F.col("id").alias("doc_id"), F.array_max(totals)["level"].cast("int").alias("level"), "words", F.round(F.exp("whole.rank_b")).cast("bigint").alias("coverage"))

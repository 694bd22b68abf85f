"""Language identification by compression with zstandard raw-content dictionaries, one per language.

Fitting takes a bounded sample: SAMPLE_DOCS labelled documents a language, those with the smallest hash of their id, an equal
share of the dictionary from the head of each (SAMPLE_CHARS at most), lower-cased. Every text is lower-cased too and
compressed whole, in chunks. A chunk's size is what it adds to a piece of the dictionary, since a short text alone might not be
compressed at all. The chunks of a text take turns over the dictionary and its slices, and go round until each of those has had a
turn: sizes of short texts are coarse, and several measurements tell them apart. The smallest sum names the language. The score is
the margin over the next language, as a share of that language's sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.rows import filtered
from panelforge.session import ship

SAMPLE_DOCS = 400
DICTIONARY_BYTES = 96 << 10
MODEL_BYTES = 24 << 20  # of all dictionaries: beyond 256 languages each has less
CHUNK = 512
SLICES = 6
LEVEL = 6
MARGIN = 0.002
LEAD = 256
SAMPLE_CHARS = 2048
UNKNOWN = "und"


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary per language from a bounded sample of the rows with text and language.

    The sample is chosen on (id, language) alone; texts are read for the chosen ids only. Rows that share an id and a language
    count once, by the least text. Rows without an id, a text or a language are not learned from; without any there is no
    dictionary. Extra columns are ignored.
    """
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    rank = F.dense_rank().over(Window.partitionBy("lang", "salt").orderBy("h", "id"))
    salted = labelled.select("id", "lang", F.xxhash64("id").alias("h"), F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    few = salted.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).select("id", "lang", "h").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    chosen = few.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).select("id", "lang", "rank")
    size = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    most = min(DICTIONARY_BYTES, MODEL_BYTES // max(1, len(size)))
    picked = labelled.join(F.broadcast(chosen), ["id", "lang"]).groupBy("lang", "rank").agg(F.min(F.substring("text", 1, min(SAMPLE_CHARS, most))).alias("text"))
    parts: dict[str, list] = {}
    for r in picked.collect():  # at most SAMPLE_DOCS texts a language
        parts.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    return {lang: "\n".join(t[: max(1, most // size[lang])].lower() for _, t in sorted(found)).encode()[-most:] for lang, found in parts.items()}


def coder(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary.ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.parts = []  # for each language: the dictionary and its slices, each with a lead and the lead's size
        for name in self.names:
            whole = dictionaries[name]
            step = max(1, len(whole) // SLICES)
            self.parts.append([self.part(whole), *(self.part(whole[a : a + step]) for a in range(0, step * SLICES, step))])

    @staticmethod
    def part(dictionary: bytes) -> tuple:
        code, lead = coder(dictionary), dictionary[:LEAD]
        return code, lead, len(code.compress(lead))

    def sizes(self, data: bytes) -> list[int]:
        """What the chunks of a whole text add to the leads, summed over their turns."""
        chunks = [data[a : a + CHUNK] for a in range(0, len(data), CHUNK)]
        turns = chunks * -(-(SLICES + 1) // len(chunks))
        out = []
        for parts in self.parts:
            total = 0
            for n, x in enumerate(turns):
                code, lead, base = parts[n % len(parts)]
                total += max(1, len(code.compress(lead + x)) - base)
            out.append(total)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); without a letter: (und, 0)."""
        if not text or not self.names or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        sizes = self.sizes(text.lower().encode())
        order = np.argsort(sizes, kind="stable")
        if len(order) == 1:
            return self.names[order[0]], 1.0
        best, second = sizes[order[0]], sizes[order[1]]
        return self.names[order[0]], (second - best) / second


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """(id, lang_pred, score, rejected) of each row; rejected: no letter, or a score below `margin`.

    A null text or one without a letter is `und` with score 0 and rejected. Without dictionaries every row is. Ties go to the
    first language by name, with score 0. Rows without an id are predicted like any other. Extra columns are ignored. An empty
    table gives an empty result. Only the text is read.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(dictionaries)  # at most MODEL_BYTES

    def classify(batches):
        model = Classifier(shared.value)
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            names, scores = [f[0] for f in found], [f[1] for f in found]
            out = [n == UNKNOWN or s < margin for n, s in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], names=["id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(classify, "id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows that identify() does not reject, with all their columns as they are.

    Null texts, empty ones and those without a letter go; repeated rows are judged alike. An empty table gives an empty result.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(dictionaries)

    def judge():
        model = Classifier(shared.value)
        return lambda texts: [n != UNKNOWN and s >= margin for n, s in map(model.predict, texts)]

    return filtered(docs, text_col, judge)

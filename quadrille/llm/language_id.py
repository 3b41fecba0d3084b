"""Language identification by compression.

Every language known from labelled rows gets a raw-content zstandard dictionary: the words of a
bounded sample of its texts, rarest first, so that the commonest lie nearest. Words that more of
another language's texts use are left out; thus passages and notices that all languages quote do not
pull a text to whichever dictionary holds them, and single words leave no long phrase to match. A text is compressed once with each dictionary and the smallest total names the
language; a narrow margin to the runner-up marks the row as rejected. What is compressed is the
text's letters, lower-cased, one blank between words, so markup and digits do not count. Long texts
are compressed in blocks, each against the dictionary anew, and the sizes are added up, so the whole
text decides.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; equal
sizes go to the language with more labelled rows; a language without words of its own has no dictionary
and still takes part; with no labelled row at all every row is ``und``; repeated rows repeat their result;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_texts

#: Bound of the training sample: bytes of dictionary for each language, and candidate rows that
#: the sample is chosen from. Texts over LONG characters are used only where shorter ones are too few.
DICTIONARY_BYTES, SAMPLE_ROWS, LONG = 64_000, 400, 6_000
#: Bytes compressed at once.
BLOCK = 4096
#: Short matches are what tells languages apart, so they are searched for down to four bytes.
LEVEL, SHORTEST_MATCH = 6, 4
#: Rows whose margin, as a part of the runner-up's size, is below this are rejected.
MARGIN = 0.01

_word = re.compile(r"[^\W\d_]+")


def letters(text: str) -> bytes:
    return " ".join(_word.findall(text.lower())).encode("utf-8")


def learn(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionary content of each language: a bounded sample of the rows where ``training`` holds.

    The sample is drawn by a hash of the text, so it does not depend on row order. The rate of each
    language follows its number of rows, so no language's rows are ever gathered whole.
    """
    rows = docs.where(training & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[lang_col].alias("lang"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("h")
    )
    size = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not size:
        return {}
    rates = F.create_map(*(F.lit(x) for lang, n in sorted(size.items()) for x in (lang, min(1.0, 4 * SAMPLE_ROWS / n))))
    drawn = rows.where(F.pmod("h", F.lit(1 << 20)) < rates[F.col("lang")] * (1 << 20))  # before any text is shuffled
    order = Window.partitionBy("lang").orderBy((F.length("text") > LONG).cast("int"), "h")
    sample = drawn.dropDuplicates(["lang", "h"]).withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_ROWS)
    used: dict[str, Counter] = {}
    texts: Counter = Counter()
    for row in sample.select("lang", "text").toLocalIterator():
        texts[row.lang] += 1
        used.setdefault(row.lang, Counter()).update(set(_word.findall(row.text.lower())))
    return {lang: dictionary(lang, used, texts) for lang in sorted(used, key=lambda x: (-size[x], x))}


def dictionary(lang: str, used: dict[str, Counter], texts: Counter) -> bytes:
    """The language's own words, at most DICTIONARY_BYTES, the commonest last."""
    rate = {m: 1 / texts[m] for m in used}
    own = [(c, w) for w, c in used[lang].items() if all(c * rate[lang] >= used[m][w] * rate[m] for m in used)]
    out, room = [], DICTIONARY_BYTES
    for _, word in sorted(own, key=lambda x: (-x[0], x[1])):
        piece = word.encode("utf-8") + b" "
        room -= len(piece)
        if room < 0:
            break
        out.append(piece)
    return b"".join(reversed(out))


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.names = list(content)
        self.coders = []
        for name in self.names:
            if len(content[name]) < 8:  # zstandard takes no shorter dictionary
                self.coders.append(zstandard.ZstdCompressor(level=level, write_content_size=False))
                continue
            made = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            plan = zstandard.ZstdCompressionParameters.from_level(
                level, source_size=BLOCK, dict_size=len(content[name]), min_match=SHORTEST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            made.precompute_compress(compression_params=plan)
            self.coders.append(zstandard.ZstdCompressor(dict_data=made, compression_params=plan))

    def sizes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def classify(self, text: str | None, margin: float = MARGIN) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the row is rejected."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(letters(text))
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for i, s in enumerate(sizes) if i != best]
        if not others:
            return self.names[best], 1.0, False
        lead = (min(others) - sizes[best]) / max(1, min(others))
        return self.names[best], 1 - math.exp(-20 * lead), lead < margin


def identify(docs: DataFrame, content: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), margin: float = MARGIN) -> DataFrame:
    """id_col, the columns in ``keep``, lang_pred, score and rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(content)  # at most DICTIONARY_BYTES a language
    kept = [docs[c].alias(f"k{i}") for i, c in enumerate((id_col, *keep))]
    narrow = docs.select(*kept, docs[text_col].alias("text"))

    def make():
        model = Classifier(shared.value)

        def work(batch: dict) -> dict:
            found = [model.classify(t, margin) for t in batch["text"]]
            out = {c: v for c, v in batch.items() if c != "text"}
            return out | {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "rejected": [f[2] for f in found]}

        return work

    head = ", ".join(f"k{i} {narrow.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(kept)))
    done = map_texts(narrow, make, f"{head}, lang_pred string, score double, rejected boolean")
    return done.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate((id_col, *keep))), "lang_pred", "score", "rejected")


def filter_identified(docs: DataFrame, content: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows that are not rejected, all their columns unchanged, in one pass and without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(content)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        model = Classifier(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield part.filter(pa.array([not model.classify(t, margin)[2] for t in part.column(at).to_pylist()], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

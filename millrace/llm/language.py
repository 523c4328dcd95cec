"""Language ID by compression.

Each language is a zstandard raw-content dictionary cut from labelled texts. A text is encoded with every language's
dictionary, in blocks so that the dictionary counts all along a long text, and the language with the smallest total
wins; narrow margins are marked as rejected. Whole bytes say little about very short texts: those are encoded behind
passages of each language, and what they add to the passages' size is compared.

Learning is bounded: one text slice for each of ``SLICES`` hash buckets of a language, ``SLICE_CHARS`` long, for at
most ``LANGUAGES`` languages (more is an error). Prediction reads whole texts and nothing else.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; without any learned
language everything is; ties go to the language first in code point order (and are rejected); exact copies fill one
bucket, so they weigh as one text in learning; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import col

from .batches import per_text, small_batches
from .drops import without

SLICES, SLICE_CHARS, LANGUAGES = 256, 600, 500
BLOCK = 512
LEVEL = 6
#: Texts below so many bytes are encoded behind passages; how many passages, and how long.
SHORT, PASSAGES, PASSAGE = 256, 8, 1024
#: Bytes that the second language needs more, as a share of the best one's; below that the text is rejected.
MARGIN = 0.002
UNKNOWN = "und"

_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def plain(text: bytes) -> bytes:
    """Lower-case letters and single blanks, so that capitals, digits and marks don't hide the words."""
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_LETTERS).split())


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of the labelled rows. One pass; each task passes on a slice per bucket at most."""
    text = col(text_col)
    key = F.xxhash64(text)
    rows = docs.filter(col(lang_col).isNotNull() & text.isNotNull()).select(
        col(lang_col).alias("lang"), F.pmod(key, F.lit(SLICES)).alias("bucket"), key.alias("key"),
        F.substring(text, 1, SLICE_CHARS).alias("slice"))
    known = rows.select("lang").distinct().limit(LANGUAGES + 1).collect()
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    picked = rows.groupBy("lang", "bucket").agg(F.min_by("slice", F.struct("key", "slice")).alias("slice")).collect()
    found: dict[str, list[bytes]] = {}
    for row in sorted(picked, key=lambda r: (r.lang, r.bucket)):
        if part := plain(row.slice.encode()):
            found.setdefault(row.lang, []).append(part)
    return {lang: b" ".join(parts) for lang, parts in found.items()}


class Model:
    """The encoders of all languages; made once per task."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)
        self.encoders = [self._encoder(dictionaries[x]) for x in self.languages]
        self.bare = zstandard.ZstdCompressor(compression_params=self._params(0, PASSAGE + SHORT))
        self.passages = []
        for x in self.languages:
            d = dictionaries[x]
            parts = [d[len(d) * j // PASSAGES:][:PASSAGE] + b" " for j in range(PASSAGES)]
            self.passages.append([(p, len(self.bare.compress(p))) for p in parts])

    @staticmethod
    def _params(dict_size: int, source_size: int) -> zstandard.ZstdCompressionParameters:
        return zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=3, write_content_size=0, write_dict_id=0, dict_size=dict_size, source_size=source_size)

    def _encoder(self, content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=self._params(len(content), BLOCK))

    def sizes(self, text: bytes) -> list[int]:
        if len(text) < SHORT:
            return [sum(len(self.bare.compress(p + text)) - n for p, n in parts) for parts in self.passages]
        blocks = [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]
        return [sum(len(e.compress(b)) for b in blocks) for e in self.encoders]

    def predict(self, raw: bytes) -> tuple[str, float, float, bool]:
        """Language, score, margin, rejected."""
        text = plain(raw)
        if not self.languages or not text or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return UNKNOWN, 0.0, 0.0, True
        sizes = [max(1, n) for n in self.sizes(text)]
        best, second = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))[0], sorted(sizes)[min(1, len(sizes) - 1)]
        if len(sizes) == 1:
            return self.languages[0], 1.0, 1.0, False
        margin = (second - sizes[best]) / sizes[best]
        return self.languages[best], 1 - sizes[best] / (second + sizes[best] * 1e-9), margin, margin < MARGIN


def classify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, margin, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded, see above

    def make() -> Callable[[bytes], tuple]:
        return Model(shared.value).predict

    return per_text(docs, make, "lang_pred string, score double, margin double, rejected boolean", id_col, text_col)


def held_out(id_col: str = "doc_id") -> Column:
    """The documents kept from learning: a quarter by checksum of the id."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, then classify all."""
    return classify(docs, learn(docs.filter(~held_out(id_col)), text_col, lang_col), id_col, text_col)


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents whose language is rejected."""
    with small_batches(docs.sparkSession):
        found = identify(docs, id_col, text_col, lang_col)
        return without(docs, found.filter("rejected").select("id"), id_col)

"""Documents sorted by their sequences of phrases, a row a document.

Equal sequences are told by a digest and sorted once. Of the others, the first
phrases are sorted as byte strings; the documents that are still alike are
sorted by some more phrases, four times as far each round, until none is.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .anchored import gapless, in_order
from .backward import Heads, indexed
from .hashmatch import dealt
from .symbols import Texts, of_texts
from .ways import bytes_of

#: Phrases of the first round, and how many times as far each next one goes.
FIRST, MORE = 16, 4


def phrase_sequences(collection: DataFrame, reference: DataFrame, index: DataFrame) -> DataFrame:
    """(order_no, doc_id, n_phrases), as :func:`matchstats.phrase_sequences` of :func:`backward.heads`; the reference must not be empty."""
    index_of = indexed(index, reference)

    def told(a: int, b: int):
        """Phrases ``a`` to ``b`` of each text; in the first round its size and digest too."""

        def columns(t: Texts) -> tuple[np.ndarray, dict]:
            n = index_of().n
            pos, length, _ = index_of().matched(t)
            h = Heads(t, pos, length)
            at, width = h.at[~h.is_end], ((n + 1) * (n + 1)).bit_length() + 7 >> 3
            raw = bytes_of(pos[at] * (n + 1) + length[at], width).tobytes()
            size = np.bincount(t.doc[at], minlength=len(t.texts))
            first = np.cumsum(size) - size
            cut = lambda lo, hi: [raw[x:y] for x, y in zip((lo * width).tolist(), (hi * width).tolist())]
            out = {"p": pa.array(cut(first + np.minimum(a, size), first + np.minimum(b, size)), pa.binary())}
            if not a:
                digests = [blake2b(x, digest_size=16).digest() for x in cut(first, first + size)]
                out |= {"n_phrases": size.astype(np.int32), "digest": pa.array(digests, pa.binary())}
            return np.arange(len(t.texts)), out

        return columns

    a, b, ranks = 0, FIRST, []
    rows = stored(of_texts(dealt(collection, "doc_id"), told(a, b), "p binary, n_phrases int, digest binary").where("n_phrases > 0"), "sequences")
    one = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "distinct")
    open_ = rows.join(one, ["digest", "doc_id"], "left_semi").select("doc_id", F.lit(0).cast("long").alias("r"), "p")
    while True:
        sorted_ = in_order(open_, ["r", "p", "doc_id"], open_.count())
        sorted_ = stored(sorted_.select("doc_id", "r", F.sha2("p", 256).alias("p"), "_id"), "sequences")
        alike = sorted_.groupBy("r", "p").agg(F.min("_id").alias("_r"), F.count("*").alias("_n"))
        ranked = stored(sorted_.join(alike, ["r", "p"]).select("doc_id", F.col("_r").alias(f"r{len(ranks)}"), "_n"), "sequences")
        ranks.append(f"r{len(ranks)}")
        one = one.join(ranked.drop("_n"), "doc_id", "left")
        more = ranked.where("_n > 1").select("doc_id", F.col(ranks[-1]).alias("r"))
        if more.isEmpty():
            break
        a, b = b, b * MORE
        texts = collection.select("doc_id", "text").join(more, "doc_id", "left_semi")
        open_ = stored(of_texts(dealt(texts, "doc_id"), told(a, b), "p binary").join(more, "doc_id").select("doc_id", "r", "p"), "sequences")
    all_ = rows.select("doc_id", "n_phrases", "digest").join(one.drop("doc_id"), "digest").drop("digest")
    return gapless(stored(in_order(all_, [*ranks, "doc_id"], all_.count()), "sequences"), "order_no").select("order_no", "doc_id", "n_phrases")

"""Pages that come in chunks: pieces are kept per page until the last, then converted.

On a batch frame this is one grouped map; on a stream a state per page, which survives restarts with the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomark.functions.markdown import Options, convert

MAX_BYTES = 10 << 20
OUT = "page_id long, markdown string, n_chunks int, status string"
STATE = "seqs array<int>, parts array<binary>, last int"


def slice_bytes(pages: DataFrame, size: int) -> DataFrame:
    """(page_id, url, seq, chunk, is_last) of pages' html in UTF-8; an empty page is one empty chunk."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", raw.alias("_raw")).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.octet_length("_raw") / size).cast("int")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("seq"))
    return rows.select("page_id", "url", "seq", F.substring("_raw", F.col("seq") * size + 1, F.lit(size)).alias("chunk"), (F.col("seq") == F.col("_n") - 1).alias("is_last"))


def _finish(key, url, parts: list[tuple[int, bytes]], options: Options) -> pd.DataFrame:
    raw = b"".join(x for _, x in sorted(parts))
    status, text = "converted", None
    if len(raw) > MAX_BYTES:
        status = "budget_exceeded"
    else:
        try:
            text = convert(raw.decode("utf-8"), url, options)
        except UnicodeDecodeError:
            status = "encoding_error"
    return pd.DataFrame({"page_id": [key], "markdown": [text], "n_chunks": pd.array([len(parts)], "int32"), "status": [status]})


def convert_chunks(chunks: DataFrame, options: Options = Options()) -> DataFrame:
    """One row a page: page_id, markdown, n_chunks, status (converted, encoding_error, budget_exceeded).
    Chunks may come in any order of seq. A streaming frame gives a page's row once all up to its last chunk are there."""
    if not chunks.isStreaming:
        def whole(key, df: pd.DataFrame) -> pd.DataFrame:
            return _finish(key[0], df["url"].iloc[0], list(zip(df["seq"], df["chunk"])), options)

        return chunks.groupBy("page_id").applyInPandas(whole, OUT)

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, parts, last = state.get if state.exists else ([], [], -1)
        held, url = dict(zip(seqs, parts)), key[1]
        for df in frames:
            for seq, chunk, is_last in zip(df["seq"], df["chunk"], df["is_last"]):
                held[int(seq)] = bytes(chunk)
                last = int(seq) if is_last else last
        if last >= 0 and len(held) == last + 1:
            if state.exists:
                state.remove()
            yield _finish(key[0], url, list(held.items()), options)
        else:
            state.update((list(held), list(held.values()), last))

    return chunks.groupBy("page_id", "url").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

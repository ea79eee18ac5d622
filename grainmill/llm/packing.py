"""Cost-balanced packing of tokenised documents into training sequences.

The cost of a piece of n tokens is estimated as n + QUADRATIC * n^2: the linear part of a transformer and its
attention within the piece. Documents are cut into whole sequences and a remainder; remainders are dealt into groups
of bounded size by a hash, and each group is packed on its own: in descending order, every remainder goes to the
cheapest sequence that still has room for it. Where none has room, it is cut over the sequences with the most room, so
a group pads its last few tokens only.

Token ids travel as two bytes each (four for vocabularies over 65,536).
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grainmill.llm import bytesops

SEQUENCE = 1024
GROUP_ROWS = 4096
QUADRATIC = 1 / 2048
VOCABULARY = "byte_bpe_50k.tiktoken"

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_ENCODERS: dict[str, object] = {}


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of the tokenizer file of the same name as a rank file; none where there is no such file."""
    file = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(file):
        return {}
    with open(file, encoding="utf-8") as lines:
        tokens = json.load(lines)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"{file}: added tokens that reach beyond their own characters")
    return {t["content"]: t["id"] for t in tokens}


def encoder(path: str):
    """Byte-pair encoder of a public rank file, opened once per process, with the tokenizer file's added tokens."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path)
        )
    return _ENCODERS[path]


def token_ids(path: str, text: str) -> list[int]:
    """Ids of a text; an added token in it is its own id, as the tokenizer file has it."""
    return encoder(path).encode(text, allowed_special="all", disallowed_special=())


def cost(n: float) -> float:
    return n + QUADRATIC * n * n


def assign(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (row, start, length, sequence, offset) that pack rows of fewer than `capacity` tokens.

    There are as many sequences as the tokens need. Sequences too full for the row at hand wait until rows are short
    enough for their room, so each is moved a few times only.
    """
    total = int(lengths.sum())
    count = -(-total // capacity)
    cheap = [(0.0, s) for s in range(count)]
    waiting: list[tuple[int, int]] = []
    used, costs, pieces = [0] * count, [0.0] * count, []

    def put(row: int, start: int, n: int, s: int) -> None:
        pieces.append((row, start, n, s, used[s]))
        used[s] += n
        costs[s] += cost(n)

    for row in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[row])
        if not n:
            continue
        while waiting and -waiting[0][0] >= n:
            _, s = heapq.heappop(waiting)
            heapq.heappush(cheap, (costs[s], s))
        while cheap and capacity - used[cheap[0][1]] < n:
            _, s = heapq.heappop(cheap)
            if used[s] < capacity:
                heapq.heappush(waiting, (used[s] - capacity, s))
        if cheap:
            _, s = heapq.heappop(cheap)
            put(row, 0, n, s)
            heapq.heappush(cheap, (costs[s], s))
            continue
        start = 0
        while start < n:
            _, s = heapq.heappop(waiting)
            take = min(n - start, capacity - used[s])
            put(row, start, take, s)
            start += take
            if used[s] < capacity:
                heapq.heappush(waiting, (used[s] - capacity, s))
    return pieces


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    end_id: int = 0,
    vocabulary: str | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then `end_id`. Null and empty texts are that one id. Every id lies in exactly one
    piece; the pieces of a sequence follow each other from offset 0. Whole sequences cut from long documents need no
    grouping. Repeated rows are documents of their own, and so may have the same id; a null id stays null. Other
    columns are ignored. An empty table gives no rows. One count runs at once, for the number of groups.
    """
    path = vocabulary or vocabulary_path()
    groups = max(1, -(-df.count() // group_rows))

    def tokenise(batches):
        serial = 0
        for batch in bytesops.chunked(batches, "text"):
            rows = {name: [] for name in ("id", "n", "start", "crc", "group", "ids")}
            for doc_id, text in zip(bytesops.column(batch, "id").to_pylist(), bytesops.column(batch, "text").to_pylist()):
                ids = token_ids(path, text) if text else []
                ids.append(end_id)
                small = np.array(ids, np.uint16 if max(ids) < 65536 else np.uint32)
                whole = len(small) // sequence * sequence
                serial += 1
                for start in range(0, len(small), sequence):
                    part = small[start : start + sequence]
                    rows["id"].append(doc_id)
                    rows["n"].append(len(small))
                    rows["start"].append(start)
                    rows["crc"].append(_crc(part))
                    rows["group"].append(serial)
                    rows["ids"].append(None if start < whole else part.tobytes())
            yield pa.RecordBatch.from_pydict(rows, schema=cut_schema)

    cut_schema = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("start", pa.int64()), ("crc", pa.int64()), ("group", pa.int64()), ("ids", pa.binary())]
    )
    parts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        tokenise, "id bigint, n bigint, start bigint, crc bigint, group bigint, ids binary"
    )
    # A group is a hash of the id and of the document's number in its task, so repeated rows do not meet in one group.
    parts = parts.withColumn("group", F.pmod(F.xxhash64("id", "group", "n"), F.lit(groups)))

    def in_group(key, frame):
        frame = frame.sort_values(["id", "n", "start", "crc"], kind="stable", na_position="first", ignore_index=True)
        lengths = np.minimum(frame["n"] - frame["start"], sequence).to_numpy()
        wide = np.array([b is not None for b in frame["ids"]], bool)
        kinds = [np.frombuffer(b, np.uint16 if len(b) == 2 * n else np.uint32) for b, n in zip(frame["ids"][wide], lengths[wide])]
        rest = frame[wide].reset_index(drop=True)
        rows = [
            (rest["id"][r], rest["start"][r] + s, n, _crc(kinds[r][s : s + n]), rest["n"][r], q, o)
            for r, s, n, q, o in assign(lengths[wide], sequence)
        ]
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        packed = pd.DataFrame(rows, columns=columns)
        # Whole sequences follow the packed ones.
        full = frame[~wide].rename(columns={"id": "doc_id", "crc": "ids_crc32", "n": "doc_tokens"})
        used = -(-int(lengths[wide].sum()) // sequence)
        full = full.assign(length=sequence, offset=0, sequence_id=used + np.arange(len(full)))
        out = pd.concat([packed, full[columns]], ignore_index=True).astype("Int64")
        out["sequence_id"] += int(key[0]) * 2**32
        return out

    return parts.groupBy("group").applyInPandas(in_group, PIECES).withColumnRenamed("doc_id", id_col)

"""Cost-balanced packing of documents into fixed-length sequences (operator 3).

Documents become token ids plus an end id.  Whole sequences are cut off each document; what is left is
packed, group by group, in descending length: each piece goes to the sequence of lowest estimated cost
(linear plus quadratic in piece length) that still has room for it.  A group opens just as many
sequences as its tokens fill, so a piece that fits nowhere whole is cut at the largest room.
Groups are formed inside each task's own input, so nothing is shuffled and none grows with the data.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidelog.llm.common import texts
from tidelog.llm.library_ids import library_ids

LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Rests packed together by one task at once, and bytes of ids in a batch that goes back to Spark.
GROUP = 4096
BATCH_BYTES = 8 << 20
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def piece_cost(length: int) -> float:
    """Estimated cost of a piece: projections grow with its length, attention with the square."""
    return LINEAR * length + QUADRATIC * length * length


def balance(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in piece, length, sequence, offset) for pieces of at most ``capacity`` tokens each.

    Descending pieces (ties: given order) go to the lowest-cost sequence with room (ties: lowest number);
    one that fits nowhere is cut to fill the sequence with most room, and the rest placed by the same rule.
    """
    n = -(-sum(lengths) // capacity)
    room = [capacity] * n
    cost = [(0.0, k) for k in range(n)]
    heapq.heapify(cost)
    todo = [(-length, k, 0) for k, length in enumerate(lengths) if length]
    heapq.heapify(todo)
    out = []
    while todo:
        negative, piece, start = heapq.heappop(todo)
        length, passed = -negative, []
        while cost and room[cost[0][1]] < length:
            passed.append(heapq.heappop(cost))
        if cost:
            c, k = heapq.heappop(cost)
            take = length
        else:
            best = max(range(len(passed)), key=lambda i: (room[passed[i][1]], -passed[i][1]))
            c, k = passed.pop(best)
            take = room[k]
            heapq.heappush(todo, (take - length, piece, start + take))
        out.append((piece, start, take, k, capacity - room[k]))
        room[k] -= take
        if room[k]:
            heapq.heappush(cost, (c + piece_cost(take), k))
        for x in passed:
            heapq.heappush(cost, x)
    return out


def pack(docs: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every id of a document's tokens and its end id lies in exactly one piece; a sequence holds at most
    ``capacity`` ids, gapless from offset 0.  Null or empty text: the end id alone.  Repeated rows are packed
    each by itself; null doc_id stays null; an empty table gives no pieces; other columns are not read.
    sequence_id: the task's partition in the high bits, a running number in the low 33.
    """
    import numpy as np

    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        lib = library_ids(vocab_path, False)
        sequence = TaskContext.get().partitionId() << 33
        rows, held, rests = [], 0, []

        def table():
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA)

        def close():
            nonlocal sequence
            used = 0
            for piece, begin, take, k, offset in balance([len(ids) // 4 for _, _, ids, _ in rests], capacity):
                doc, start, ids, total = rests[piece]
                rows.append((doc, start + begin, take, ids[4 * begin:4 * (begin + take)], total, sequence + k, offset))
                used = max(used, k + 1)
            sequence += used
            rests.clear()

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), lib.bytes_of(batch.column("text")), strict=True):
                ids += end
                total = len(ids) // 4
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, capacity, ids[4 * start:4 * (start + capacity)], total, sequence, 0))
                    sequence += 1
                if total > whole:
                    rests.append((doc, whole, ids[4 * whole:], total))
                held += len(ids)
                if len(rests) >= GROUP:
                    close()
                if held >= BATCH_BYTES and rows:
                    yield table()
                    rows, held = [], 0
        if rests:
            close()
        if rows:
            yield table()

    return texts(docs).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

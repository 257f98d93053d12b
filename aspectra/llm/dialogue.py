"""Operator 12: conversation structure repair by a rank-convergence parallel Viterbi search.

The rows of a conversation, in order, are edited at least cost so that the initials of their roles spell
``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert of an empty user or assistant
row 5; a truncated row that is not deleted adds 5; blank and repeated rows must go.  The costs to the end
of the conversation, a vector over the four states of that pattern, come from a backward search:

* a conversation is cut into chunks of rows; all chunks start at once, from the vector that holds at the
  end of a conversation;
* in fix-up passes a chunk whose successor begins with another vector is run again, until the vectors
  differ from those used by constants only, which change no decision;
* the stitched costs drive the forward search: of the edits that keep to the least cost the first in the
  alphabet (D, I, K, R) is taken.  Chunks are traced from every state; their exits are then put in order.

Rows are sorted over the cluster by conversation, turn, role and text.  A conversation that lies inside one
partition and has at most ``CHUNK`` rows is one chunk and is finished there.  Any other is cut into segments,
one for each partition that it touches, and segments into chunks; fix-up passes run inside the tasks and
then between segments.  A large conversation is thus spread over all tasks that hold its rows; only the
digest of its whole repaired text, which has to be read in order, is computed by one task, in a stream.

Defined results: null roles and texts are one space; null turns come first; rows of one turn are ordered
by role, then text; a null ``conv_id`` is a conversation of its own; other columns are ignored; an empty
table gives an empty result.  A role whose initial is not s, u or a, the empty role included, is never kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.tables import group_starts, grouped, written

#: rows of a chunk
CHUNK = 1024
ROLES = ("system", "user", "assistant")
_GAP = " \t\n\x0b\x0c\r"
_BIG = 1 << 40

# fixed values: costs of the edits
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
# states: nothing yet, after s, after u, after a; the state that the next u or a leads to
_NEXT = np.array([2, 2, 3, 2])
#: by state and initial (s, u, a, other): the state that keeping the row leads to, -1 if it does not fit
_KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: the costs at the end of a conversation
END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
_LETTERS = np.frombuffer(b"\0DIKR", dtype=np.uint8)


def key(c: Column | str) -> Column:
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after the damage that the checksum of conversation and turn deals."""
    dealt = F.crc32(F.encode(F.concat(key("conv_id"), F.lit(":"), key("turn")), "UTF-8")) % 20
    text = F.when(dealt == 1, "").when(dealt == 2, F.regexp_replace(key("text"), "[.!?]", "")).otherwise(key("text"))
    return (conversations.filter(dealt != 0)
            .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    F.when(dealt == 4, "user").otherwise(key("role")).alias("role"), text.alias("text"),
                    F.explode(F.sequence(F.lit(1), F.when(dealt == 3, 2).otherwise(1))).alias("_copy"))
            .drop("_copy"))


# ---- the search ----------------------------------------------------------------------------------

def _closed(v: np.ndarray) -> np.ndarray:
    """The cheapest costs where rows may be inserted first."""
    u, a = np.minimum(v[:, 2], INSERT + v[:, 3]), np.minimum(v[:, 3], INSERT + v[:, 2])
    return np.stack([np.minimum(v[:, 0], INSERT + u), np.minimum(v[:, 1], INSERT + u), u, a], axis=1)


def backward(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs to the end before each row and after the last, ``[n + 1, lanes, 4]``, from ``end [lanes, 4]``.

    ``codes [lanes, n]``: initial (0 s, 1 u, 2 a, 3 other), 4 for truncated, 8 for must go, 16 for no row.
    """
    lanes, n = codes.shape
    out = np.empty((n + 1, lanes, 4), dtype=np.int64)
    out[n] = end
    for i in range(n - 1, -1, -1):
        c, v = codes[:, i], out[i + 1]
        initial, penalty = c & 3, TRUNCATED * ((c >> 2) & 1) + _BIG * ((c >> 3) & 1)
        as_user = penalty + REROLE * (initial != 1) + v[:, 2]
        as_assistant = penalty + REROLE * (initial != 2) + v[:, 3]
        as_system = np.where(initial == 0, penalty, _BIG) + v[:, 1]
        new = DELETE + v
        new[:, 0] = np.minimum(new[:, 0], np.minimum(as_user, as_system))
        new[:, 1] = np.minimum(new[:, 1], as_user)
        new[:, 2] = np.minimum(new[:, 2], as_assistant)
        new[:, 3] = np.minimum(new[:, 3], as_user)
        out[i] = np.where((c >= 16)[:, None], v, _closed(new))
    return out


def trace(codes: np.ndarray, costs: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least edits of each lane from its ``state``: letters ``[steps, lanes]``, exit state and cost.

    Only a lane that is ``last`` of its conversation inserts rows after its own.
    """
    lanes = len(state)
    lane, length = np.arange(lanes), (codes < 16).sum(axis=1)
    at, state, cost = np.zeros(lanes, dtype=np.int64), state.copy(), np.zeros(lanes, dtype=np.int64)
    padded = np.concatenate([codes, np.full((lanes, 1), 16, codes.dtype)], axis=1)
    letters = []
    while True:
        over = at >= length
        live = ~(over & (~last | (state == 0) | (state == 3)))
        if not live.any():
            break
        here, after = costs[at, lane, state], costs[np.minimum(at + 1, len(costs) - 1), lane]
        c = padded[lane, at]
        penalty = TRUNCATED * ((c >> 2) & 1) + _BIG * (c >> 3)
        keep = _KEEP[state, c & 3]
        delete = ~over & (DELETE + after[lane, state] == here)
        insert = INSERT + costs[at, lane, _NEXT[state]] == here
        kept = ~over & (keep >= 0) & (penalty + after[lane, keep] == here)
        edit = np.select([~live, delete, insert, kept], [0, 1, 2, 3], 4)
        cost += np.select([edit == 1, edit == 2, edit == 3, edit == 4], [DELETE, INSERT, penalty, REROLE + penalty], 0)
        state = np.select([edit == 3, (edit == 2) | (edit == 4)], [keep, _NEXT[state]], state)
        at += (edit != 0) & (edit != 2)
        letters.append(_LETTERS[edit])
    return (np.stack(letters) if letters else np.zeros((0, lanes), np.uint8)), state, cost


def _lanes(runs: list[np.ndarray]) -> np.ndarray:
    """Rows of codes side by side."""
    out = np.full((len(runs), max(map(len, runs), default=0)), 16, dtype=np.int64)
    for k, codes in enumerate(runs):
        out[k, :len(codes)] = codes
    return out


def _relative(v: np.ndarray) -> np.ndarray:
    return v - v.min(axis=-1, keepdims=True)


def settle(codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Costs of all chunks (lanes) of a segment that ends with ``end``; their end vectors, and the passes taken."""
    ends = np.tile(END, (len(codes), 1))
    ends[-1] = end
    costs, passes = backward(codes, ends), 1
    while True:
        due = np.concatenate([_relative(costs[0])[1:], ends[-1:]])
        stale = np.flatnonzero((_relative(ends) != _relative(due)).any(axis=1))
        if not len(stale):
            return costs, ends, passes
        ends[stale] = due[stale]
        costs[:, stale] = backward(codes[stale], ends[stale])
        passes += 1


def _strings(letters: np.ndarray) -> list[str]:
    return [col[col > 0].tobytes().decode() for col in letters.T]


def lines(rows: list[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The repaired rows ``(role, text)``: those of a conversation after the edits of its audit."""
    role, left = "", iter(rows)
    for edit in audit:
        if edit == "I":
            row = ("", "")
        else:
            row = next(left)
            if edit == "D":
                continue
        role = row[0] if edit == "K" else "assistant" if role[:1] == "u" else "user"
        yield role, row[1]


def illegal_pairs(initial: np.ndarray) -> int:
    """Neighbours that are not su, ua or au."""
    a, b = initial[:-1], initial[1:]
    return int(len(a) - (((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))).sum())


# ---- conversations inside one partition ----------------------------------------------------------

_ROW = "ck string, part int, off long, turn long, role string, text string, code int"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FIXED = "fixed array<struct<role: string, text: string>>"
_PAIRS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_RESULT_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order over the partitions; ``code``: initial, 4 for truncated, 8 for blank."""
    bare = F.rtrim(F.col("text"), F.lit(_GAP))
    initial = F.substring("role", 1, 1)
    code = (F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
            + F.when(bare == "", 8).when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(4))
    kept = rows.select(key("conv_id").alias("ck"), F.col("turn").cast("long").alias("turn"), key("role").alias("role"),
                       key("text").alias("text"))
    # equal rows are told apart, so that many of them are not one task's
    spread = kept.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange("ck", "turn", "role", "text", "_n")
    return spread.sortWithinPartitions("ck", "turn", "role", "text").select("ck", "turn", "role", "text", code.alias("code"))


def _faults(code: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blank, duplicate and truncated rows, and the codes of the search."""
    blank = code >= 8
    duplicate = repeated & ~blank
    truncated = ((code & 4) > 0) & ~blank & ~duplicate
    return blank, duplicate, truncated, (code & 3) + 4 * truncated + 8 * (blank | duplicate)


def _finished(t: pa.Table, starts: np.ndarray) -> list[tuple]:
    """The results of whole conversations of at most CHUNK rows."""
    bounds = np.r_[starts, t.num_rows]
    code = t.column("code").to_numpy()
    roles, texts, turns, cks = (t.column(c).to_pylist() for c in ("role", "text", "turn", "ck"))
    runs, out = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        pairs = list(zip(roles[a:b], texts[a:b]))
        seen: set = set()
        repeated = np.array([p in seen or seen.add(p) is not None for p in pairs], dtype=bool)
        blank, duplicate, truncated, codes = _faults(code[a:b], repeated)
        known = {x for x in turns[a:b] if x is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        runs.append(codes)
        out.append((cks[a], pairs, gaps, int(blank.sum()), int(duplicate.sum()), int(truncated.sum()), illegal_pairs(codes & 3)))
    matrix = _lanes(runs)
    costs = backward(matrix, np.tile(END, (len(runs), 1)))
    letters, _, cost = trace(matrix, costs, np.zeros(len(runs), dtype=np.int64), np.ones(len(runs), dtype=bool))
    done = []
    for (ck, pairs, *rest), c, audit in zip(out, cost.tolist(), _strings(letters)):
        fixed = list(lines(pairs, audit))
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in fixed).encode()).hexdigest()
        done.append((ck, *rest, c, audit, digest, [{"role": role, "text": text} for role, text in fixed]))
    return done


def _first_pass(batches, texts: bool) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that end inside the partition; rows of all others, numbered."""
    part = TaskContext.get().partitionId()
    off, held, open_key = 0, None, None
    names = [c.split()[0] for c in _ROW.split(", ")] + _RESULT_NAMES + ["fixed"]

    def opened(t: pa.Table) -> Iterator[pa.RecordBatch]:
        nones = [pa.nulls(t.num_rows, pa.string() if c.endswith(" string") else pa.int64()) for c in _RESULT.split(", ")]
        nones.append(pa.nulls(t.num_rows, _PAIRS))
        cols = [t.column("ck"), pa.array(np.full(t.num_rows, part, np.int32)), t.column("off"), t.column("turn"),
                t.column("role"), t.column("text"), t.column("code")]
        yield from pa.Table.from_arrays([*cols, *nones], names).to_batches(max_chunksize=10_000)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]).append_column("off", pa.array(np.arange(off, off + batch.num_rows)))
        off += batch.num_rows
        if held is not None:
            t = pa.concat_tables([held, t])
        t = t.combine_chunks()
        starts = group_starts(t, ["ck"])
        if open_key is None:
            open_key = t.column("ck")[0].as_py()
        a = 0
        if t.column("ck")[0].as_py() == open_key:  # the first of the partition, or one that has grown large
            a = int(starts[1]) if len(starts) > 1 else t.num_rows
            yield from opened(t.slice(0, a))
        b = int(starts[-1])
        if a < t.num_rows:
            whole = starts[(starts >= a) & (starts < b)]
            large = np.diff(np.r_[whole, b]) > CHUNK if len(whole) else np.zeros(0, dtype=bool)
            for k in np.flatnonzero(large):
                yield from opened(t.slice(int(whole[k]), int(np.r_[whole, b][k + 1] - whole[k])))
            small = whole[~large]
            ends = np.r_[whole, b][1:][~large] if len(whole) else small
            for k in range(0, len(small), 2000):
                some, stops = small[k:k + 2000], ends[k:k + 2000]
                mine = pa.concat_tables([t.slice(int(x), int(y - x)) for x, y in zip(some, stops)]).combine_chunks()
                results = _finished(mine, np.r_[0, np.cumsum(stops - some)[:-1]])
                cols = [pa.array([r[j] for r in results], pa.string() if j in (0, 7, 8) else pa.int64()) for j in range(9)]
                cols.append(pa.array([r[9] if texts else None for r in results], _PAIRS))
                n = len(results)
                nulls = [pa.nulls(n, x) for x in (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())]
                yield pa.RecordBatch.from_arrays([cols[0], *nulls, *cols[1:]], names)
            held = t.slice(b)
            if held.num_rows > CHUNK:
                open_key = t.column("ck")[b].as_py()
                yield from opened(held)
                held = None
        else:
            held = None
    if held is not None:
        yield from opened(held)


# ---- conversations over several partitions -------------------------------------------------------

def _segments(rows: DataFrame) -> DataFrame:
    """``(ck, part, codes)``: the rows of a conversation in one partition, as a string of codes in order."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    told = rows.select("ck", "part", "off", "code", said.alias("said"))
    first = told.groupBy("ck", "said").agg(F.min(F.struct("part", "off")).alias("f")).select(
        F.col("f.part").alias("part"), F.col("f.off").alias("off"), F.lit(True).alias("new"))
    marked = told.join(first, ["part", "off"], "left").withColumn(
        "code", F.when(F.col("code") >= 8, F.col("code")).when(F.col("new"), F.col("code")).otherwise(16 + F.col("code")))
    codes = F.transform(F.sort_array(F.collect_list(F.struct("off", "code"))), lambda x: x["code"])
    return marked.groupBy("ck", "part").agg(codes.alias("codes"))


def _search_codes(lists: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Faults and codes of the search of each segment; 16 in the input marks a repeated row."""
    codes = (np.array(x, dtype=np.int64) for x in lists.to_pylist())
    return [_faults(x & 15, x >= 16) for x in codes]


def _chunks(codes: np.ndarray) -> np.ndarray:
    return _lanes([codes[a:a + CHUNK] for a in range(0, len(codes), CHUNK)])


def _begin(batches) -> Iterator[pa.RecordBatch]:
    """The vector with which each segment begins, up to a constant."""
    for batch in batches:
        begin = []
        for (*_, codes), end in zip(_search_codes(batch.column("codes")), batch.column("end").to_pylist()):
            costs, _, _ = settle(_chunks(codes), np.array(end, dtype=np.int64))
            begin.append(_relative(costs[0, 0]).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("ck"), batch.column("part"), pa.array(begin, pa.list_(pa.int64()))],
                                         ["ck", "part", "begin"])


def stitched(segments: DataFrame) -> DataFrame:
    """``(ck, part, codes, end, last)``: ``end`` is the true vector behind each segment, up to a constant."""
    following = segments.select("ck", "part", F.lead("part").over(
        Window.partitionBy("ck").orderBy("part")).alias("next"))
    base = written(segments.join(following, ["ck", "part"]), "segments")
    end = F.array(*[F.lit(int(x)) for x in END]).cast("array<long>")
    begun = written(base.withColumn("end", end).select("ck", "part", "codes", "end").mapInArrow(
        _begin, "ck string, part int, begin array<long>").withColumn("end", end), "begun")
    while True:
        ahead = begun.select(F.col("ck"), F.col("part").alias("next"), F.col("begin").alias("due"))
        links = base.select("ck", "part", "next").join(ahead, ["ck", "next"], "left")
        now = begun.join(links, ["ck", "part"]).withColumn("due", F.coalesce("due", end))
        stale = now.filter(F.col("due") != F.col("end")).select("ck", "part", F.col("due").alias("end"))
        stale = written(stale, "stale")
        if stale.isEmpty():
            break
        again = stale.join(base.select("ck", "part", "codes"), ["ck", "part"]).select("ck", "part", "codes", "end")
        again = again.mapInArrow(_begin, "ck string, part int, begin array<long>").join(stale, ["ck", "part"])
        begun = written(begun.join(stale.select("ck", "part"), ["ck", "part"], "left_anti").unionByName(again), "begun")
    return base.join(begun.select("ck", "part", "end"), ["ck", "part"]).select(
        "ck", "part", "codes", "end", F.col("next").isNull().alias("last"))


def _exits(batches) -> Iterator[pa.RecordBatch]:
    """For each segment: its exit from every state, its faults, and the initials at its edges."""
    for batch in batches:
        rows = []
        for (blank, duplicate, truncated, codes), end, last in zip(
                _search_codes(batch.column("codes")), batch.column("end").to_pylist(), batch.column("last").to_pylist()):
            chunks = _chunks(codes)
            leave, _, _ = _traced(chunks, settle(chunks, np.array(end, dtype=np.int64))[0], last)
            state = np.arange(4)
            for k in range(len(chunks)):
                state = leave[k][state]
            initial = codes & 3
            rows.append((state.tolist(), int(blank.sum()), int(duplicate.sum()), int(truncated.sum()),
                         illegal_pairs(initial), int(initial[0]), int(initial[-1])))
        kinds = [pa.list_(pa.int64()), *[pa.int64()] * 6]
        yield pa.RecordBatch.from_arrays(
            [batch.column("ck"), batch.column("part"), *[pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]],
            ["ck", "part", "exits", "blank", "duplicate", "truncated", "illegal", "first", "final"])


def _traced(chunks: np.ndarray, costs: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exit state, cost and letters of every chunk from each of the four states."""
    n = len(chunks)
    four = np.repeat(np.arange(n), 4)
    final = np.zeros(4 * n, dtype=bool)
    final[-4:] = last
    letters, leave, cost = trace(chunks[four], costs[:, four], np.tile(np.arange(4), n), final)
    return leave.reshape(n, 4), cost.reshape(n, 4), letters


def _entries(batches) -> Iterator[pa.RecordBatch]:
    """The state in which each segment is entered; pairs of initials between segments count as the later one's."""
    ck, state, before = None, 0, None
    for batch in batches:
        entry, illegal = [], []
        for k, exits, bad, first, final in zip(*(batch.column(c).to_pylist() for c in ("ck", "exits", "illegal", "first", "final"))):
            if k != ck:
                ck, state, before = k, 0, None
            entry.append(state)
            illegal.append(bad + (illegal_pairs(np.array([before, first])) if before is not None else 0))
            state, before = exits[state], final
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("ck", "part", "blank", "duplicate", "truncated")] + [pa.array(illegal, pa.int64()), pa.array(entry, pa.int64())],
            ["ck", "part", "blank", "duplicate", "truncated", "illegal", "entry"])


def _audits(batches) -> Iterator[pa.RecordBatch]:
    """The edits of each segment and their cost."""
    for batch in batches:
        audit, spent = [], []
        for (*_, codes), end, last, state in zip(_search_codes(batch.column("codes")), *(
                batch.column(c).to_pylist() for c in ("end", "last", "entry"))):
            chunks = _chunks(codes)
            leave, cost, letters = _traced(chunks, settle(chunks, np.array(end, dtype=np.int64))[0], last)
            parts, total = [], 0
            for k in range(len(chunks)):
                parts.append(_strings(letters[:, 4 * k + state:4 * k + state + 1])[0])
                total += int(cost[k, state])
                state = int(leave[k, state])
            audit.append("".join(parts))
            spent.append(total)
        yield pa.RecordBatch.from_arrays([batch.column("ck"), batch.column("part"), pa.array(audit, pa.string()), pa.array(spent, pa.int64())],
                                         ["ck", "part", "audit", "cost"])


def _actions(batches) -> Iterator[pa.RecordBatch]:
    """For each row of a segment its edit, and the number of rows inserted before it; for what follows the last row a row of its own."""
    for batch in batches:
        for ck, part, audit, offs in zip(*(batch.column(c).to_pylist() for c in ("ck", "part", "audit", "offs"))):
            edits, inserts, n = [], [], 0
            for e in audit:
                if e == "I":
                    n += 1
                else:
                    edits.append(e)
                    inserts.append(n)
                    n = 0
            edits.append("I")
            inserts.append(n)
            offs = [*offs, offs[-1] + 1]
            for a in range(0, len(edits), 10_000):
                k = len(edits[a:a + 10_000])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ck] * k), pa.array([part] * k, pa.int32()), pa.array(offs[a:a + k], pa.int64()), pa.array(edits[a:a + k]),
                     pa.array(inserts[a:a + k], pa.int64())], ["ck", "part", "off", "edit", "inserts"])


def _lines_in_order(batches) -> Iterator[list[tuple[str, str, str]]]:
    """``(ck, role, text)`` of the repaired rows, a list for each batch of edited rows."""
    ck, role = None, ""
    for batch in batches:
        out = []
        for k, edit, inserts, own, text in zip(*(batch.column(c).to_pylist() for c in ("ck", "edit", "inserts", "role", "text"))):
            if k != ck:
                ck, role = k, ""
            for _ in range(inserts):
                role = "assistant" if role[:1] == "u" else "user"
                out.append((ck, role, ""))
            if edit in "KR":
                role = own if edit == "K" else "assistant" if role[:1] == "u" else "user"
                out.append((ck, role, text))
        yield out


def _hashes(batches) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation that keeps a row."""
    now, sha = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["ck", "repaired_sha256"])

    for lines_of in _lines_in_order(batches):
        for ck, role, text in lines_of:
            if ck == now:
                sha.update(f"\n{role}:{text}".encode())
                continue
            if now is not None:
                yield done()
            now, sha = ck, hashlib.sha256(f"{role}:{text}".encode())
    if now is not None:
        yield done()


def _repaired(batches) -> Iterator[pa.RecordBatch]:
    now, pos = None, 0
    for lines_of in _lines_in_order(batches):
        places = []
        for ck, _, _ in lines_of:
            now, pos = ck, pos + 1 if ck == now else 0
            places.append(pos)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in lines_of], pa.string()), pa.array(places, pa.int64()),
             pa.array([r[1] for r in lines_of], pa.string()), pa.array([r[2] for r in lines_of], pa.string())],
            ["ck", "pos", "role", "text"])


def _searched(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faults and audits of the segments of ``rows (ck, part, off, turn, role, text, code)``, and the rows with their edits."""
    ends = written(stitched(_segments(rows)), "ends")
    exits = ends.mapInArrow(_exits, "ck string, part int, exits array<long>, blank long, duplicate long, truncated long, "
                                    "illegal long, first long, final long")
    entries = written(grouped(exits, ["ck"], _entries, "ck string, part int, blank long, duplicate long, truncated long, "
                                                       "illegal long, entry long", order=["part"]), "entries")
    audits = written(ends.join(entries.select("ck", "part", "entry"), ["ck", "part"]).mapInArrow(
        _audits, "ck string, part int, audit string, cost long"), "audits")
    offs = rows.groupBy("ck", "part").agg(F.sort_array(F.collect_list("off")).alias("offs"))
    actions = audits.join(offs, ["ck", "part"]).mapInArrow(_actions, "ck string, part int, off long, edit string, inserts long")
    return entries, audits, actions.join(rows.select("part", "off", "ck", "role", "text"), ["ck", "part", "off"], "left")


def _spread_out(rows: DataFrame) -> DataFrame:
    """The results of the conversations whose rows lie in several places."""
    entries, audits, edited = _searched(rows)
    hashes = grouped(edited, ["ck"], _hashes, "ck string, repaired_sha256 string", order=["part", "off"])
    counts = entries.groupBy("ck").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    told = audits.groupBy("ck").agg(
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    turns = rows.groupBy("ck").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    return (turns.join(counts, "ck").join(told, "ck").join(hashes, "ck", "left")
            .withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
            .select("ck", *_RESULT_NAMES))


def _passed(rows: DataFrame, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """The finished conversations, and the rows of all others."""
    passed = written(_ordered(rows).mapInArrow(partial(_first_pass, texts=texts), f"{_ROW}, {_RESULT}, {_FIXED}"), "conversations")
    return passed.filter("off is null"), passed.filter("off is not null").select("ck", "part", "off", "turn", "role", "text", "code")


def repair(rows: DataFrame) -> DataFrame:
    """``(ck, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of each conversation.

    ``rows (conv_id, turn, role, text)``; ``ck`` is the id as text, one space for null.
    """
    inside, others = _passed(rows)
    return inside.select("ck", *_RESULT_NAMES).unionByName(_spread_out(others))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``(ck, pos, role, text)``: the repaired conversations themselves, rows counted from 0."""
    inside, others = _passed(rows, texts=True)
    one = inside.select("ck", F.posexplode("fixed").alias("pos", "f")).select(
        "ck", F.col("pos").cast("long").alias("pos"), "f.role", "f.text")
    _, _, edited = _searched(others)
    return one.union(grouped(edited, ["ck"], _repaired, "ck string, pos long, role string, text string", order=["part", "off"]))


def repaired(conversations: DataFrame) -> DataFrame:
    """The results of ``repair`` on the damaged rows, for every ``conv_id`` of ``conversations``."""
    found = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), key("conv_id").alias("ck")).distinct()
    nothing = {c: "" if c == "audit" else hashlib.sha256(b"").hexdigest() if c == "repaired_sha256" else 0 for c in _RESULT_NAMES}
    return every.join(found, "ck", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(v).cast("string" if isinstance(v, str) else "long")).alias(c) for c, v in nothing.items()])

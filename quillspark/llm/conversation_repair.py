"""Repair of damaged conversations by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import stored

#: Rows and characters of text in a piece of a conversation that is searched and written out at once.
PIECE_ROWS, PIECE_CHARS = 64, 4 << 20
#: What each edit costs, and what a truncated row that is not deleted adds.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
BLANK, DUPLICATE, TRUNCATED, FINE = "b", "d", "t", "-"
VISIBLE = r"[^\x20\x09-\x0D]"
#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. The first and the last may end a conversation.
ENDS = (0, 3)
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def _edits(rows: list[tuple[str, str]], last: bool, i: int, q: int) -> list[tuple[str, int, int, int]]:
    """(initial, cost, row, state) of what can be done at row i in state q, in ASCII order of initials. Rows are (role's initial, fault)."""
    out = []
    if i < len(rows):
        out.append(("D", DELETE, i + 1, q))
    if i < len(rows) or last:
        out.append(("I", INSERT, i, _NEXT[q]))
    if i < len(rows) and rows[i][1] not in (BLANK, DUPLICATE):
        more = CUT_OFF if rows[i][1] == TRUNCATED else 0
        if (q, rows[i][0]) in _KEPT:
            out.append(("K", more, i + 1, _KEPT[q, rows[i][0]]))
        out.append(("R", REROLE + more, i + 1, _NEXT[q]))
    return out


def search(rows: list[tuple[str, str]], start: int = 0, end: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that lead from a state to another, ASCII-least where several are; end None: to where a conversation may end.

    Depth first in ASCII order under a bound of cost, which rises to the least estimate that was beyond it. A state that failed
    is kept with the least cost that it is known to have left, so it is not entered again before the bound allows that; the
    first path that is accepted is the answer. Only where a conversation ends are rows inserted behind the last one, so of
    two audits of a piece none begins the other, and pieces can be searched one by one.
    """
    n, last = len(rows), end is None
    left = [0] * (n + 1)  # a row with a fault costs at least a deletion
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (0 if rows[i][1] == FINE else min(DELETE, CUT_OFF) if rows[i][1] == TRUNCATED else DELETE)
    done = lambda q: q in ENDS if last else q == end
    known: dict[tuple[int, int], int] = {}
    bound, most = left[0], (DELETE + REROLE + CUT_OFF) * n + 2 * INSERT
    while bound <= most:
        # a frame: row, state, cost so far, edits still to try, least estimate beyond the bound
        stack, path = [[0, start, 0, None, most + 1]], []
        while stack:
            i, q, cost, edits, beyond = frame = stack[-1]
            if edits is None:
                if i == n and done(q):
                    return cost, "".join(path)
                frame[3] = edits = iter(_edits(rows, last, i, q))
            for name, price, to, state in edits:
                estimate = price + max(left[to], known.get((to, state), 0))
                if cost + estimate <= bound:
                    stack.append([to, state, cost + price, None, most + 1])
                    path.append(name)
                    break
                beyond = min(beyond, estimate)
                frame[4] = beyond
            else:
                known[i, q] = max(known.get((i, q), 0), beyond)
                stack.pop()
                if stack:
                    path.pop()
                    above = stack[-1]
                    above[4] = min(above[4], cost - above[2] + known[i, q])
        if known[0, start] <= bound:
            return None
        bound = known[0, start]
    return None


def _reachable(rows: list[tuple[str, str]], start: int, end: int) -> bool:
    """Whether any edits lead from a state to another without an insertion behind the last row: only a kept row leads to the state after s."""
    return end in (2, 3) or start == end or (end == 1 and start == 0 and any(r == ("s", FINE) or r == ("s", TRUNCATED) for r in rows))


def _search_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece the cheapest edits between any two states; of a first piece from the start only, of a last one to an end only."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            rows = list(zip(r["initials"], r["faults"], strict=True))
            for start in (0,) if r["first"] else range(4):
                for end in (None,) if r["last"] else [e for e in range(4) if _reachable(rows, start, e)]:
                    if found := search(rows, start, end):
                        out.append((r["_c"], r["piece"], start, -1 if end is None else end, *found))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_c", "piece", "start", "end", "cost", "audit"])


def compose(pieces: list[dict[tuple[int, int], tuple[int, str]]]) -> list[tuple[int, int, str]]:
    """(state before, cost, audit) for each piece of a conversation: the cheapest and then least edits through all. A piece: (start, end) to (cost, audit); end -1: an end."""
    best: dict[int, tuple[int, str, tuple]] = {0: (0, "", ())}
    for piece in pieces:
        step: dict[int, tuple[int, str, tuple]] = {}
        for (start, end), (cost, audit) in piece.items():
            if start in best:
                before = best[start]
                new = (before[0] + cost, before[1] + audit, (before[2], (start, cost, audit)))
                if end not in step or new[:2] < step[end][:2]:
                    step[end] = new
        best = step
    chain, out = best[-1][2], []
    while chain:
        chain, own = chain
        out.append(own)
    return out[::-1]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range with place and piece: a piece ends with its conversation, its range, PIECE_ROWS or PIECE_CHARS."""
    n, piece, held, chars, now = 0, -1, 0, 0, None
    for batch in batches:
        place, pieces = [], []
        for c, size, p in zip(batch.column("_c").to_pylist(), batch.column("_size").to_pylist(), batch.column("_p").to_pylist(), strict=True):
            if c != now or held == PIECE_ROWS or (held and chars + size > PIECE_CHARS):
                now, piece, held, chars = c, piece + 1, 0, 0
            place.append((p << 40) + n)
            pieces.append((p << 40) + piece)
            n, held, chars = n + 1, held + 1, chars + size
        yield pa.RecordBatch.from_arrays([batch.column("_c"), batch.column("role"), batch.column("text"), batch.column("turn"), pa.array(place, pa.int64()), pa.array(pieces, pa.int64())], names=["_c", "role", "text", "turn", "place", "piece"])


def repaired_lines(rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """`role:text` of the rows (role, text) that an audit leaves, reroles or inserts, from a state on."""
    out, at = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit == "K":
            state = _KEPT[state, role[0]]
        else:
            state = _NEXT[state]
            role = {2: "user", 3: "assistant"}[state]
        out.append(f"{role}:{text}")
    return out


def _write_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = ["\n".join(repaired_lines([(x["role"], x["text"]) for x in r], audit, state)) for r, audit, state in zip(batch.column("rows").to_pylist(), batch.column("audit").to_pylist(), batch.column("start").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_c"), batch.column("piece"), pa.array(texts, pa.string())], names=["_c", "piece", "lines"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a conversation's lines, piece after piece; nothing but the state of the hash is kept."""
    now, state, begun = None, None, False
    for batch in batches:
        out = []
        for c, lines in zip(batch.column("_c").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if c != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state, begun = c, hashlib.sha256(), False
            if lines:
                state.update((("\n" if begun else "") + lines).encode())
                begun = True
        cols = list(zip(*out, strict=True)) or [()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["_c", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["_c", "repaired_sha256"])


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows as damage leaves them, by crc32 of `conv:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ends of sentences, 3 repeats it, 4 makes its role user. A null in any column that is read counts as one space."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    kept = rows.select(F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").alias(turn_col), F.when(kind == 4, "user").otherwise(said(role_col)).alias(role_col), text.alias(text_col), F.explode(F.array_repeat(F.lit(0), times)).alias("_t"))
    return kept.drop("_t")


def _key(conv: Column) -> Column:
    """A conversation's id as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair_conversations(rows: DataFrame, every: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Of a row its first fault counts: blank (nothing visible), duplicate (role and text are those of an earlier row), truncated (the last
    visible character ends no sentence). Edits make the roles' initials fit `(s?(ua)+)?`: Keep 0, Rerole to user or assistant 1,
    Delete 2 (blank and duplicate rows must go), Insert an empty turn 5; truncated rows that stay add 5. Of the cheapest edits
    those with the ASCII-least initials are taken, see search().

    Rows are dealt into ranges of (conversation, turn, role, text) and cut into pieces of PIECE_ROWS rows, so that a conversation of
    any length is searched in many tasks, between all states at its cuts; a row per piece and pair of states brings the pieces
    together. Only the hash, which goes over all of a conversation's lines, is made in one task, piece after piece.

    Defined cases: a null role or text is one space, so such a text is blank and such a role has to be changed; null turns come first,
    equal turns by role and text; turns that are null don't count for gaps; a null conversation id is a conversation of its own; a role
    counts by its first letter, an empty one has none; conversations of `every` (all that there were before damage) without rows
    have zeros, an empty audit and the hash of nothing; an empty table gives an empty result; other columns are ignored.
    """
    conv, turn = F.col(f"`{conv_col}`"), F.col(f"`{turn_col}`").cast("long")
    clean = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    given = rows.select(_key(conv).alias("_c"), turn.alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text"))
    order = [F.col("_c"), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    dealt = given.repartitionByRange(*order).withColumn("_p", F.spark_partition_id().cast("long")).withColumn("_size", F.length("text"))
    numbered = dealt.sortWithinPartitions("_c", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(_number, "_c string, role string, text string, turn long, place long, piece long")
    held = stored(numbered.withColumn("_h", F.sha2("text", 256)))

    # faults, without texts
    first = held.groupBy("_c", "role", "_h").agg(F.min("place").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    seen = held.join(first, ["_c", "role", "_h"], "left")
    last = F.regexp_extract("text", rf"({VISIBLE})[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(F.col("place") > F.col("_first"), DUPLICATE).when(~last.rlike("^[.!?]$"), TRUNCATED).otherwise(FINE)
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    marked = seen.select("_c", "piece", "place", "turn", initial.alias("initial"), fault.alias("fault"))
    pieces = marked.groupBy("_c", "piece").agg(F.sort_array(F.collect_list(F.struct("place", "initial", "fault"))).alias("l"), *[F.count_if(F.col("fault") == f).alias(name) for f, name in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))], F.max("turn").alias("hi"), F.min("turn").alias("lo"))
    initials, along = F.array_join("l.initial", ""), W.partitionBy("_c").orderBy("piece")  # a row per piece
    pieces = pieces.withColumns({"initials": initials, "faults": F.array_join("l.fault", "")})
    pieces = stored(pieces.withColumns({"before": F.lag(F.substring("initials", -1, 1)).over(along), "first": F.lag("piece").over(along).isNull(), "last": F.lead("piece").over(along).isNull()}).drop("l"))
    pairs = F.concat(F.coalesce("before", F.lit("")), F.col("initials"))
    wrong = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.length(pairs)), lambda i: F.substring(pairs, i, 2)), lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))
    turns = held.where("turn IS NOT NULL").groupBy("_c").agg(F.countDistinct("turn").alias("turns"))
    counts = pieces.groupBy("_c").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(wrong).cast("long").alias("illegal"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    counts = counts.join(turns, "_c", "left").withColumn("gaps", F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)))

    # edits
    kinds = "_c string, piece long, start int, end int, cost long, audit string"
    tables = stored(pieces.select("_c", "piece", "initials", "faults", "first", "last").mapInArrow(_search_pieces, kinds))
    cut = pieces.where("NOT (first AND last)").select("_c").distinct()
    whole = tables.join(cut, "_c", "left_anti").select("_c", "piece", "start", "cost", "audit")

    def together(group):
        import pandas as pd

        g = [({(s, e): (int(c), a) for s, e, c, a in zip(x["start"], x["end"], x["cost"], x["audit"], strict=True)}, p) for p, x in group.sort_values("piece").groupby("piece")]
        out = compose([x for x, _ in g])
        return pd.DataFrame({"_c": group["_c"].iloc[0], "piece": [p for _, p in g], "start": [s for s, _, _ in out], "cost": [c for _, c, _ in out], "audit": [a for _, _, a in out]})

    # of a conversation in pieces: as many characters as its audit has, times the pairs of states
    joined = tables.join(cut, "_c", "left_semi").groupBy("_c").applyInPandas(together, "_c string, piece long, start int, cost long, audit string")
    chosen = stored(whole.unionByName(joined))
    audits = chosen.groupBy("_c").agg(F.sum("cost").alias("cost"), F.array_join(F.sort_array(F.collect_list(F.struct("piece", "audit")))["audit"], "").alias("audit"))

    # lines
    own = held.select("_c", "piece", "place", "role", "text").groupBy("_c", "piece").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("rows"))  # a piece
    lines = own.join(chosen, ["_c", "piece"]).select("_c", "piece", "rows", "audit", "start").mapInArrow(_write_pieces, "_c string, piece long, lines string")
    digests = lines.repartition("_c").sortWithinPartitions("_c", "piece").mapInArrow(_digests, "_c string, repaired_sha256 string")

    names = every if every is not None else rows
    ids = names.select(F.col(f"`{conv_col}`").alias("_id")).distinct().withColumn("_c", _key(F.col("_id")))
    zero = F.lit(0).cast("long")
    return ids.join(counts, "_c", "left").join(audits, "_c", "left").join(digests, "_c", "left").select(
        F.col("_id").alias(conv_col), *[F.coalesce(F.col(c), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    )


__all__ = ["compose", "damage", "repair_conversations", "repaired_lines", "search"]

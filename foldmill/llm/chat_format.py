"""Chat formatting: roles recovered by a hidden Markov model, turns rendered canonically.

A transcript is plain text. Each of its lines with content is in one of six
states, the beginning or the inside of a turn of one of three roles; what is
observed of it is a speaker marker (or none), whether a blank line went before,
and a class of length. Start, transition and emission counts come from labelled
turns (a bounded sample), over prior counts that tie markers to roles; Viterbi
decoding gives the states, which cut the text into turns. A turn is rendered as
<|im_start|>role, its text without the marker, <|im_end|>.

Conversations are cut into pieces of ``piece`` turn numbers, and blocks of many rows
(equal numbers, or none) into smaller ones, so that a conversation that holds a
third of all rows is spread like any other data. Cuts change no state: where a
conversation has several pieces, each gives the best score from every state before
it to every state at its end (a matrix); the matrices are multiplied in order, in
segments and then over segments, and say in which state the best path of the whole
conversation enters and leaves each piece, which is decoded between the two.

Results by case: null texts are empty turns and leave no line; unknown or null
roles count as user when transcripts are made; turns without a number come first;
turns of equal number are ordered by a hash of role and text; rows that are equal
in all columns stay repeated; a conversation without lines has no turns, a row with
empty text; a null conv_id is a conversation; of equally good paths any may be taken,
the same one on every run; empty tables give no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.llm._shared import saved, table

ROLES = ["system", "user", "assistant"]
#: Words that mark a speaker.
MARKERS = {"system": ["system", "context", "instructions"], "user": ["user", "human", "customer", "question", "q"], "assistant": ["assistant", "ai", "bot", "answer", "response", "a"]}
_MARK = re.compile(r"^\s{0,3}(?:#{1,4}\s*|\*\*|\[)?(" + "|".join(w for r in ROLES for w in MARKERS[r]) + r")(?:\*\*|\])?\s*(?::\*{0,2}|(?<=[A-Za-z])\]|$)[ \t]*", re.I)
_ROLE_OF = {w: i for i, r in enumerate(ROLES) for w in MARKERS[r]}
STATES, SYMBOLS = 6, 24
#: How raw transcripts mark turns: (user, assistant, system), each followed by the text.
STYLES = [("User: ", "Assistant: ", "System: "), ("Human: ", "AI: ", "Context: "), ("Q: ", "A: ", "Instructions: "), ("### User:\n", "### Response:\n", "### System:\n"), ("**Customer:** ", "**Bot:** ", "**System:** ")]


def observe(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lines of a text, the places of those with content, and what is observed of them."""
    lines = text.split("\n")
    at, seen, blank = [], [], True
    for i, x in enumerate(lines):
        if not x or x.isspace():
            blank = True
            continue
        m = _MARK.match(x)
        mark = 1 + _ROLE_OF[m[1].lower()] if m else 0
        at.append(i)
        seen.append(mark * 6 + blank * 3 + (len(x) > 40) + (len(x) > 200))
        blank = False
    return lines, at, seen


def prior() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts to start from; states are role * 2 + inside."""
    start, move, emit = np.full(STATES, 0.01), np.full((STATES, STATES), 0.05), np.full((STATES, SYMBOLS), 0.02)
    for r in range(3):
        start[2 * r] = 1
        emit[2 * r, (1 + r) * 6 : (2 + r) * 6] += 1
        emit[2 * r, 3:6] += 0.3
        emit[2 * r + 1, :6] += 1
        for s in (2 * r, 2 * r + 1):
            move[s, 2 * r + 1] += 1
            for q in range(3):
                move[s, 2 * q] += 0.5 * (q != r)
            move[s, [2 * q + 1 for q in range(3) if q != r]] = 1e-6
    start[1::2] = 1e-6
    return start, move, emit


class RoleModel:
    def __init__(self, start, move, emit):
        self.start, self.move = np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True))
        self.emit = np.log(emit / emit.sum(1, keepdims=True))

    def through(self, seen: list[int]) -> np.ndarray:
        """Best scores from each state before the lines (the last one: the beginning of all) to each state at their end."""
        v = np.full((STATES + 1, STATES + 1), -np.inf)
        np.fill_diagonal(v, 0)
        for k, o in enumerate(seen):
            own = np.full((STATES + 1, STATES + 1), -np.inf)
            own[:STATES, :STATES], own[STATES, :STATES] = self.move + self.emit[:, o], self.start + self.emit[:, o]
            v = times(v, own) if k else own
        return v

    def viterbi(self, seen: list[int], enter: int = STATES, leave: int | None = None) -> list[int]:
        """The best states, given the one before the lines (STATES: none) and, perhaps, the last one."""
        if not seen:
            return []
        v = (self.start if enter == STATES else self.move[enter]) + self.emit[:, seen[0]]
        back = []
        for o in seen[1:]:
            way = v[:, None] + self.move
            back.append(way.argmax(0))
            v = way.max(0) + self.emit[:, o]
        out = [int(v.argmax()) if leave is None else leave]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def turns(self, text: str) -> list[tuple[str, str]]:
        """(role, text without marker) of each turn."""
        lines, at, seen = observe(text)
        return [(ROLES[r], t) for r, t, _ in cut_turns(lines, at, self.viterbi(seen))]


def cut_turns(lines: list[str], at: list[int], states: list[int], goes_on: bool = False) -> list[tuple[int, str, bool]]:
    """(role, text without marker, whether it begins here) of each turn; where lines went before (``goes_on``), the first may be the rest of an earlier turn."""
    cut, out = [], []
    for i, s in zip(at, states):
        if s % 2 == 0 or not cut:
            cut.append((i, s // 2, s % 2 == 0))
    for k, (i, role, begins) in enumerate(cut):
        own = lines[i : cut[k + 1][0] if k + 1 < len(cut) else len(lines)]
        if begins or (k == 0 and not goes_on):
            own[0] = _MARK.sub("", own[0], count=1)
        out.append((role, "\n".join(own).strip("\n"), begins))
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best scores of a path through ``a`` and then ``b``."""
    return (a[:, :, None] + b[None]).max(1)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def raw_transcript(turns: list[tuple[str | None, str | None]], style: int, unmarked: int = 0) -> tuple[str, list[int]]:
    """A plain transcript of labelled turns and the true state of each of its lines with content. With ``unmarked``, every so many turns lack their marker (which ones, follows from the text)."""
    text, states = [], []
    for role, own in turns:
        own = (own or "").strip("\n")
        if not own.strip():
            continue
        r = ROLES.index(role) if role in ROLES else 1
        bare = unmarked and zlib.crc32(own.encode()) % unmarked == 0
        piece = own if bare else STYLES[style % len(STYLES)][(2, 0, 1)[r]] + own
        n = sum(1 for x in piece.split("\n") if x and not x.isspace())
        text.append(piece)
        states += [2 * r] + [2 * r + 1] * (n - 1)
    return "\n\n".join(text), states


def conversation_pieces(turns: DataFrame, piece: int = 1024, rows: int = 4096) -> DataFrame:
    """conv_id, piece (struct, in order) and ts (array of turn, role, text, in order) of ``turns``; a block of ``piece`` turn numbers with over ``rows`` rows is cut further, by turn, hash and copies."""
    text, role, turn = turns["text"].cast("string"), turns["role"].cast("string"), turns["turn"].cast("long")
    own = turns.select("conv_id", F.coalesce(F.floor(turn / piece), F.lit(-1 << 62)).cast("long").alias("block"), turn.alias("turn"), F.xxhash64(role, text).alias("h"), role.alias("role"), text.alias("text"))
    heavy = saved(own.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows), "chat-heavy")
    where = lambda turn, part, copy: F.struct("block", turn.cast("long").alias("turn"), part.cast("long").alias("part"), copy.cast("long").alias("copy")).alias("piece")
    item = F.struct("turn", "h", "role", "text").alias("t")
    zero = F.lit(0)
    if heavy.isEmpty():
        placed = own.select("conv_id", where(zero, zero, zero), item)
    else:
        key, total = F.struct("conv_id", "block"), heavy.agg(F.sum("n")).first()[0]
        own, heavy = own.withColumn("key", key), heavy.select(key.alias("key"), "n")
        hot, rest = F.broadcast(heavy.where(F.col("n") * 1000 > total)), heavy.where(F.col("n") * 1000 <= total)
        cool = own.join(hot.select("key"), "key", "left_anti").join(rest, "key", "left")
        big = cool.where("n is not null").unionByName(own.join(hot, "key"))
        counted = big.groupBy("key", "conv_id", "block", "turn", "h", "role", "text").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
        each = counted.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        # Parts are ranges of the hash, as many as the block's rows ask for, so that they are in the order of the turns.
        part = F.floor((F.shiftright("h", 32) + (1 << 31)) * F.ceil(F.col("n") / rows) / (1 << 32))
        big = each.select("conv_id", where(F.coalesce("turn", zero), part, F.floor(F.col("c") / rows)), item)
        placed = cool.where("n is null").select("conv_id", where(zero, zero, zero), item).unionByName(big)
    pieces = placed.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return saved(pieces, "chat-pieces")


def _transcripts(batch: pa.RecordBatch, unmarked: int = 0):
    for conv, ts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
        yield raw_transcript([(t["role"], t["text"]) for t in ts], hashlib.md5(str(conv).encode()).digest()[0], unmarked)


def train_roles(pieces: DataFrame, max_pieces: int = 1000, unmarked: int = 16) -> RoleModel:
    """Counts over the ``max_pieces`` pieces (of conversation_pieces) with the smallest hash (all, where there are fewer); every ``unmarked``-th turn lacks its marker in training, as real transcripts have it."""
    chosen = pieces.select("conv_id", "piece").where("conv_id is not null").orderBy(F.xxhash64("conv_id", "piece"), "conv_id", "piece").limit(max_pieces)

    def run(batches):
        n = np.zeros(STATES + STATES * STATES + STATES * SYMBOLS)
        for batch in batches:
            for text, states in _transcripts(batch, unmarked):
                _, _, seen = observe(text)
                for i, (s, o) in enumerate(zip(states, seen)):
                    n[s if i == 0 else STATES + states[i - 1] * STATES + s] += 1
                    n[STATES + STATES * STATES + s * SYMBOLS + o] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], names=["k", "n"])

    total = np.zeros(STATES + STATES * STATES + STATES * SYMBOLS)
    own = pieces.join(F.broadcast(chosen), ["conv_id", "piece"], "left_semi")
    for r in own.mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most a row for each count
        total[r["k"]] = r["n"]
    start, move, emit = prior()
    return RoleModel(start + total[:STATES], move + total[STATES : STATES + 36].reshape(6, 6), emit + total[STATES + 36 :].reshape(STATES, SYMBOLS))


def _borders(pieces: DataFrame, model: RoleModel) -> DataFrame:
    """conv_id, piece, enter, leave (states before and at the end of the piece on the best path of the whole conversation), last (no line comes after it) of the pieces of conversations with several."""
    kind, at = pieces.schema["conv_id"].dataType.simpleString(), pieces.schema["piece"].dataType.simpleString()
    several = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id")
    many = STATES + 1

    def matrices(batches):
        for batch in batches:
            made = [model.through(observe(text)[2]).ravel().tolist() for text, _ in _transcripts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.float64()))], names=["conv_id", "piece", "m"])

    segment = F.struct(F.floor(F.col("piece.block") / 256).alias("block"), F.floor(F.col("piece.turn") / 256).alias("turn"), F.floor(F.col("piece.part") / 256).alias("part"), F.floor(F.col("piece.copy") / 256).alias("copy"))
    # Null ids are equal here, too.
    own = pieces.alias("p").join(several.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")), "left_semi")
    own = saved(own.mapInArrow(matrices, f"conv_id {kind}, piece {at}, m array<double>").withColumn("segment", segment), "chat-matrices")
    at_segment = own.schema["segment"].dataType.simpleString()

    def ordered(batches, by: str) -> tuple[pa.Table, list[np.ndarray]]:
        table = pa.Table.from_batches(list(batches))
        keys = [tuple(k.values()) for k in table.column(by).to_pylist()]
        order = sorted(range(len(keys)), key=keys.__getitem__)
        table = table.take(pa.array(order, pa.int64()))
        return table, [np.array(m).reshape(many, many) for m in table.column("m").to_pylist()]

    def product(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ms = ordered(batches, "piece")
        yield pa.RecordBatch.from_arrays([table.column("conv_id").slice(0, 1).combine_chunks(), table.column("segment").slice(0, 1).combine_chunks(), pa.array([reduce(times, ms).ravel().tolist()], pa.list_(pa.float64()))], names=["conv_id", "segment", "m"])

    def states(ms: list[np.ndarray], v: np.ndarray, leave: int | None, more: bool) -> tuple[list[int], list[int], list[np.ndarray], list[bool]]:
        """Of each step: the state before it and after it, the scores before it, and whether lines come after it."""
        before = []
        for m in ms:
            before.append(v)
            v = (v[:, None] + m).max(0)
        x, enter, exits, follows = int(v.argmax()) if leave is None else leave, [], [], []
        for v, m in zip(reversed(before), reversed(ms)):
            exits.append(x)
            x = int((v + m[:, x]).argmax())
            enter.append(x)
            follows.append(more)
            more = more or bool(np.isinf(m[STATES, STATES]))  # nothing stays at the beginning where there are lines
        return enter[::-1], exits[::-1], before, follows[::-1]

    def over(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ms = ordered(batches, "segment")
        begin = np.full(many, -np.inf)
        begin[STATES] = 0
        _, exits, before, follows = states(ms, begin, None, False)
        yield pa.RecordBatch.from_arrays([table.column("conv_id").combine_chunks(), table.column("segment").combine_chunks(), pa.array([v.tolist() for v in before], pa.list_(pa.float64())), pa.array(exits, pa.int32()), pa.array(follows)], names=["conv_id", "segment", "v", "leave", "more"])

    def within(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, ms = ordered(batches, "piece")
        v, leave, more = (table.column(c)[0].as_py() for c in ("v", "out", "more"))
        enter, exits, _, follows = states(ms, np.array(v), leave, more)
        yield pa.RecordBatch.from_arrays([table.column("conv_id").combine_chunks(), table.column("piece").combine_chunks(), pa.array(enter, pa.int32()), pa.array(exits, pa.int32()), pa.array([not f for f in follows])], names=["conv_id", "piece", "enter", "leave", "last"])

    segments = own.groupBy("conv_id", "segment").applyInArrow(product, f"conv_id {kind}, segment {at_segment}, m array<double>")
    told = saved(segments.groupBy("conv_id").applyInArrow(over, f"conv_id {kind}, segment {at_segment}, v array<double>, leave int, more boolean"), "chat-segments")
    same = F.col("o.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("o.segment") == F.col("t.segment"))
    joined = own.alias("o").join(told.alias("t"), same).select("o.*", "t.v", F.col("t.leave").alias("out"), "t.more")
    return saved(joined.groupBy("conv_id", "segment").applyInArrow(within, f"conv_id {kind}, piece {at}, enter int, leave int, last boolean"), "chat-borders", (own, told))


def parse_transcripts(texts: DataFrame, model: RoleModel) -> DataFrame:
    """transcript_id, turns (array of role and text), rendered for every row of ``texts`` (transcript_id, text)."""
    kind = texts.schema["transcript_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            turns = [model.turns(t or "") for t in batch.column(1).to_pylist()]
            said = pa.array([[{"role": r, "text": t} for r, t in ts] for ts in turns], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), said, pa.array([render(ts) for ts in turns], pa.string())], names=["transcript_id", "turns", "rendered"])

    return texts.select("transcript_id", F.col("text").cast("string")).mapInArrow(run, f"transcript_id {kind}, turns array<struct<role:string,text:string>>, rendered string")


def format_conversations(pieces: DataFrame, model: RoleModel) -> DataFrame:
    """conv_id, piece, n_lines, n_lines_right, n_turns, n_turns_true, rendered, states (of each line with content): labelled turns (conversation_pieces) made into plain transcripts, parsed again by the model alone.

    A conversation of one piece is one row; the texts of longer ones, put together
    in the order of their pieces, are the rendered conversation.
    """
    kind, at = pieces.schema["conv_id"].dataType.simpleString(), pieces.schema["piece"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            borders = zip(*(batch.column(c).to_pylist() for c in ("enter", "leave", "last")))
            for (text, states), (enter, leave, last) in zip(_transcripts(batch), borders):
                lines, places, seen = observe(text)
                got = model.viterbi(seen, STATES if enter is None else enter, leave if seen else None)
                before = enter not in (None, STATES)
                own = cut_turns(lines, places, got, before)
                out = []
                for k, (role, t, begins) in enumerate(own):
                    goes_on = k == 0 and before
                    out.append("\n\n" + t if goes_on and not begins else ("<|im_end|>\n" if k or goes_on else "") + f"<|im_start|>{ROLES[role]}\n{t}")
                # A turn is closed where the next one begins, the last one of a conversation at its end.
                end = "<|im_end|>\n" if own and last in (None, True) else ""
                turns = sum(begins for _, _, begins in own) + bool(own and not own[0][2] and not before)
                rows.append((len(states), sum(a == b for a, b in zip(got, states)), turns, sum(s % 2 == 0 for s in states), "".join(out) + end, got))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.list_(pa.int32()))], names=["conv_id", "piece", "n_lines", "n_lines_right", "n_turns", "n_turns_true", "rendered", "states"])

    schema = f"conv_id {kind}, piece {at}, n_lines long, n_lines_right long, n_turns long, n_turns_true long, rendered string, states array<int>"
    alone = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    if alone:
        told = pieces.select("conv_id", "piece", "ts", *(F.lit(None).cast(k).alias(c) for c, k in (("enter", "int"), ("leave", "int"), ("last", "boolean"))))
    else:
        borders = _borders(pieces, model)
        same = F.col("p.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("p.piece") == F.col("b.piece"))
        told = pieces.alias("p").join(borders.alias("b"), same, "left").select("p.*", "b.enter", "b.leave", "b.last")
    return told.mapInArrow(run, schema)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of a conversation (one, up to 1,024 turn numbers), as rendered from the plain transcript by the model."""
    pieces = conversation_pieces(table(spark, sf_dir, "conversations"))
    out = format_conversations(pieces, train_roles(pieces))
    return out.drop("states").withColumn("piece", F.col("piece.block")).withColumn("rendered_sha256", F.sha2(F.col("rendered").cast("binary"), 256))

"""Conversation structure repair by a run-length dynamic program.

Turns of a conversation in order are kept (0), given the role user or assistant (2), or deleted (3), and
empty user or assistant turns are inserted (2), until the roles read ``(s?(ua)+)?``. Blank turns and
repeats of a role and text must go; a cut-off turn that is not deleted costs 1. Of all cheapest repairs the
one whose edit initials (Delete, Insert, Keep, Rerole) are least is taken.

1. Turns become small rows without their text: ids, the text's SHA-256, the class of the role, the fault.
   Equal rows are counted before the shuffle, and repeats found by the least turn of a role and text.
2. The rows are sorted by range, so that a long conversation lies in many tasks, and every task collapses
   its stretch of a conversation to runs of equal role/fault symbols: a few bytes a run.
3. The runs of a conversation meet. A symbol is a min-plus matrix over the four states of the pattern;
   a run moves the costs-to-go back by the cached binary powers of its matrix, and the choices are then
   unrolled forward, a block of a run at a time. This holds a byte or so a turn, as the audit does.
4. Texts move once, sorted by conversation behind its audit, and stream through: edited turns come out,
   or their SHA-256, with no conversation held.

Defined results: a null role or text counts as one space, null turns come first, a null conv_id is a
conversation; turns that tie go by role, then by the SHA-256 of their text; the initial of an empty role fits nothing;
equal rows are repeats; extra columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.resampling import SQL_CRC, sql_crc
from veilscan.llm.tables import table, written
from veilscan.session import ship_by_value

ship_by_value(__name__)

BLANKS = " \t\n\x0b\x0c\r"
#: Runs that one row of a conversation's stretch holds, and turns unrolled at once.
RUNS = 1 << 16
UNROLLED = 1 << 12

#: Classes of role initials, and the symbol of turns that must go (others: class + 4 if cut off).
SYSTEM, USER, ASSISTANT, OTHER, GONE = 0, 1, 2, 3, 8
#: States of the pattern: nothing yet, after s, after u, after a.
STATES = range(4)
PLACE = ("has", "conv", "known", "turn", "role", "digest")
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def inserted(state: int) -> int:
    """The state after an inserted (or renamed) turn, whose role is the only one that fits."""
    return 3 if state == 2 else 2


def kept(state: int, kind: int) -> int | None:
    """The state after a turn of this class as it is, None where it doesn't fit."""
    if kind == SYSTEM:
        return 1 if state == 0 else None
    if kind == USER:
        return None if state == 2 else 2
    return 3 if kind == ASSISTANT and state == 2 else None


def times(matrix: tuple, costs: tuple) -> tuple:
    """Min-plus product of a matrix and a vector of costs-to-go."""
    return tuple(min(m + c for m, c in zip(row, costs)) for row in matrix)


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> tuple:
    """Costs from state to state over 2^k turns of one symbol, with any inserts before each."""
    if k:
        half = power(symbol, k - 1)
        columns = list(zip(*half))
        return tuple(tuple(min(a + b for a, b in zip(row, column)) for column in columns) for row in half)
    far = 1 << 60
    rows = []
    for start in STATES:
        row = [far] * 4
        for n, state in enumerate((start, inserted(start), inserted(inserted(start)))):
            ends = [(state, 3)]
            if symbol != GONE:
                cut = symbol // 4
                ends += [(kept(state, symbol % 4), cut), (inserted(state), 2 + cut)]
            for end, cost in ends:
                if end is not None:
                    row[end] = min(row[end], 2 * n + cost)
        rows.append(tuple(row))
    return tuple(rows)


def advanced(symbol: int, n: int, costs: tuple) -> tuple:
    """Costs-to-go before ``n`` turns of a symbol, given those after them."""
    k = 0
    while n:
        if n & 1:
            costs = times(power(symbol, k), costs)
        n, k = n >> 1, k + 1
    return costs


@lru_cache(maxsize=1 << 16)
def choice(symbol: int, state: int, after: tuple) -> tuple[str, int]:
    """(least letters of a cheapest way over one turn, the state behind it); costs-to-go as differences."""
    before, letters = times(power(symbol, 0), after), ""
    cost = before[state]
    while True:
        if 3 + after[state] == cost:
            return letters + "D", state
        turned = inserted(state)
        if 2 + before[turned] == cost:
            letters, state, cost = letters + "I", turned, cost - 2
            continue
        cut = symbol // 4
        fits = kept(state, symbol % 4)
        if fits is not None and cut + after[fits] == cost:
            return letters + "K", fits
        return letters + "R", turned


#: Costs-to-go at the end: what is missing of the pattern is inserted.
AT_END = (0, 4, 2, 0)


def audit(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """(cost, edit initials) of the cheapest repair of runs (symbol, length)."""
    costs = [AT_END]
    for symbol, n in reversed(runs):
        costs.append(advanced(symbol, n, costs[-1]))
    state, letters = 0, []
    for (symbol, n), behind in zip(runs, reversed(costs[:-1])):
        for left in range(n, 0, -UNROLLED):
            block = min(left, UNROLLED)
            tails = [advanced(symbol, left - block, behind)]
            while len(tails) < block:
                tails.append(times(power(symbol, 0), tails[-1]))
            for after in reversed(tails):
                least = min(after)
                more, state = choice(symbol, state, tuple(c - least for c in after))
                letters.append(more)
    return costs[-1][0], "".join(letters) + "I" * (AT_END[state] // 2)


@lru_cache(maxsize=1 << 14)
def short_audit(runs: tuple) -> tuple[int, str]:
    return audit(list(runs))


def placed(turns: DataFrame) -> DataFrame:
    """Turns by their place: null ids and turns as flags and 0, null roles and texts as one space."""
    text = F.coalesce("text", F.lit(" "))
    return turns.select(
        F.col("conv_id").isNotNull().alias("has"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))


def marked(turns: DataFrame) -> DataFrame:
    """One small row for equal turns: place, kind (class of the role), n, cut, blank, repeated."""
    end = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    small = placed(turns).select(
        *PLACE, kind.alias("kind"), (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    small = small.groupBy(*PLACE, "kind", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    small = written(small, "turns")
    said = ["has", "conv", "role", "digest"]
    first = small.groupBy(*said).agg(F.min(F.struct("known", "turn")).alias("first"), F.count(F.lit(1)).alias("places"))
    first = first.where("places > 1").drop("places")
    return small.join(first, said, "left").withColumn(
        "repeated", F.col("first").isNotNull() & (F.struct("known", "turn") != F.col("first"))).drop("first")


STRETCH = (
    "has boolean, conv long, known boolean, turn long, role string, digest binary, symbols binary, lengths binary, "
    "blank long, duplicate long, truncated long, illegal long, first_kind long, last_kind long, turns long, "
    "first_turn long, last_turn long"
)


class Stretch:
    """Consecutive turns of one conversation as runs, with its counts."""

    def __init__(self, place: tuple):
        self.place, self.symbols, self.lengths = place, [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_kind = self.last_kind = self.first_turn = self.last_turn = None

    def run(self, symbol: int, n: int) -> None:
        if self.symbols and self.symbols[-1] == symbol:
            self.lengths[-1] += n
        elif n:
            self.symbols.append(symbol)
            self.lengths.append(n)

    def add(self, known: bool, turn: int, kind: int, n: int, blank: bool, cut: bool, repeated: bool) -> None:
        if self.first_kind is None:
            self.first_kind = kind
        else:
            self.illegal += not legal(self.last_kind, kind)
        self.illegal += n - 1
        self.last_kind = kind
        if known:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if blank:
            self.blank += n
            self.run(GONE, n)
            return
        stays = int(not repeated)
        self.duplicate += n - stays
        if stays:
            self.truncated += cut
            self.run(kind + 4 * cut, 1)
        self.run(GONE, n - stays)

    def row(self) -> tuple:
        return (*self.place, np.array(self.symbols, np.uint8).tobytes(), np.array(self.lengths, np.int64).tobytes(),
                self.blank, self.duplicate, self.truncated, self.illegal, self.first_kind, self.last_kind, self.turns,
                self.first_turn, self.last_turn)


def legal(kind: int, following: int) -> bool:
    return (kind, following) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(schema)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def stretches(small: DataFrame) -> DataFrame:
    """Rows of ``STRETCH``: what each task has of a conversation, at most ``RUNS`` runs in one."""
    schema = arrow_schema(STRETCH)

    def run(batches):
        open_, rows = None, []
        for batch in batches:
            for has, conv, known, turn, role, digest, *facts in zip(*(c.to_pylist() for c in batch.columns)):
                if open_ is None or open_.place[:2] != (has, conv) or len(open_.symbols) >= RUNS:
                    if open_ is not None:
                        rows.append(open_.row())
                    open_ = Stretch((has, conv, known, turn, role, digest))
                open_.add(known, turn, *facts)
            if len(rows) > 1000:
                yield as_batch(rows, schema)
                rows = []
        if open_ is not None:
            rows.append(open_.row())
        yield as_batch(rows, schema)

    order = small.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
    return order.select(*PLACE, "kind", "n", "blank", "cut", "repeated").mapInArrow(run, STRETCH)


DECIDED = "has boolean, conv long, " + ", ".join(f"{f} long" for f in FACTS) + ", audit string"


def wrapped(n: int) -> int:
    """As a long, which wraps."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def conclusion(parts: list[dict]) -> tuple:
    """Facts, cost and audit of a conversation from its stretches in order."""
    total = {f: sum(p[f] for p in parts) for f in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(not legal(a["last_kind"], b["first_kind"]) for a, b in zip(parts, parts[1:]))
    numbered = [p for p in parts if p["turns"]]
    gaps = 0
    if numbered:
        distinct = sum(p["turns"] for p in numbered) - sum(
            a["last_turn"] == b["first_turn"] for a, b in zip(numbered, numbered[1:]))
        gaps = numbered[-1]["last_turn"] - numbered[0]["first_turn"] + 1 - distinct
    runs: list[tuple[int, int]] = []
    for part in parts:
        for symbol, n in zip(part["symbols"], np.frombuffer(part["lengths"], np.int64).tolist()):
            if runs and runs[-1][0] == symbol:
                n += runs.pop()[1]
            runs.append((symbol, n))
    cost, letters = short_audit(tuple(runs)) if len(runs) <= 64 and sum(n for _, n in runs) <= 256 else audit(runs)
    return wrapped(gaps), total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost, letters


def decided(turns: DataFrame) -> DataFrame:
    """Rows of ``DECIDED``: facts and audit of every conversation with turns."""
    schema = arrow_schema(DECIDED)

    def run(batches):
        held, rows = [], []
        for batch in batches:
            for part in batch.to_pylist():
                if held and (held[0]["has"], held[0]["conv"]) != (part["has"], part["conv"]):
                    rows.append((held[0]["has"], held[0]["conv"], *conclusion(held)))
                    held = []
                held.append(part)
            if len(rows) > 1000:
                yield as_batch(rows, schema)
                rows = []
        if held:
            rows.append((held[0]["has"], held[0]["conv"], *conclusion(held)))
        yield as_batch(rows, schema)

    runs = stretches(marked(turns)).repartition("has", "conv").sortWithinPartitions(*PLACE)
    return runs.mapInArrow(run, DECIDED)


class Edited:
    """The edits of one conversation, met by its turns in order."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, 0

    def insert(self):
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            self.state = inserted(self.state)
            yield "I", "user" if self.state == 2 else "assistant", ""

    def turn(self, role: str, text: str):
        yield from self.insert()
        edit = self.letters[self.at]
        self.at += 1
        if edit == "K":
            self.state = kept(self.state, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]])
        elif edit == "R":
            self.state = inserted(self.state)
            role = "user" if self.state == 2 else "assistant"
        yield edit, role, text


def streamed(turns: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (kind 0), each followed by the turns of its conversation in order (kind 1)."""
    facts = [*FACTS, "audit"]
    first = decisions.select(
        "has", "conv", F.lit(0).alias("kind"), F.lit(False).alias("known"), F.lit(0).cast("long").alias("turn"),
        F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"), *facts)
    none = [F.lit(None).cast("string" if f == "audit" else "long").alias(f) for f in facts]
    rest = placed(turns).select("has", "conv", F.lit(1).alias("kind"), "known", "turn", "role", "digest", "text", *none)
    return first.union(rest).repartition("has", "conv").sortWithinPartitions("has", "conv", "kind", *PLACE[2:]).select(
        "has", "conv", "kind", "role", "text", *facts)


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: all turns of ``turns(conv_id, turn, role, text)`` and the inserted
    ones in order, with what is done to each; those with edit D are not in the repaired conversation."""
    schema = arrow_schema("conv_id long, place long, edit string, role string, text string")

    def run(batches):
        edits, id_, place, rows = None, None, 0, []

        def put(found):
            nonlocal place
            for edit, role, text in found:
                rows.append((id_, place, edit, role, text))
                place += 1

        for batch in batches:
            for has, conv, kind, role, text, *facts in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if edits:
                        put(edits.insert())
                    edits, id_, place = Edited(facts[-1]), conv if has else None, 0
                else:
                    put(edits.turn(role, text))
            yield as_batch(rows, schema)
            rows = []
        if edits:
            put(edits.insert())
        yield as_batch(rows, schema)

    decisions = written(decided(turns), "decided-conversations")
    return streamed(turns, decisions).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def report(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation
    of ``turns``; the last over lines ``role:text`` of the repaired one."""
    ddl = "conv_id long, " + ", ".join(f"{f} long" for f in FACTS) + ", audit string, repaired_sha256 string"
    schema = arrow_schema(ddl)

    def run(batches):
        edits, facts_of, hash_, rows = None, None, None, []

        def put(found):
            nonlocal empty
            for edit, role, text in found:
                if edit != "D":
                    hash_.update(("" if empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    empty = False

        empty = True
        for batch in batches:
            for has, conv, kind, role, text, *facts in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if edits:
                        put(edits.insert())
                        rows.append((*facts_of, hash_.hexdigest()))
                    edits, facts_of, hash_, empty = Edited(facts[-1]), (conv if has else None, *facts), hashlib.sha256(), True
                else:
                    put(edits.turn(role, text))
            yield as_batch(rows, schema)
            rows = []
        if edits:
            put(edits.insert())
            rows.append((*facts_of, hash_.hexdigest()))
        yield as_batch(rows, schema)

    decisions = written(decided(turns), "decided-conversations")
    return streamed(turns, decisions).mapInArrow(run, ddl)


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with faults put in by crc32(``conv_id:turn``) modulo 20: 0 drops a turn, 1 empties
    its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.withColumn("fault", fault).where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def query(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = report(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    zero = [F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in FACTS]
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


SQL = rf"""
WITH RECURSIVE {SQL_CRC}
damaged AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
          {sql_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault
        FROM conversations, crc_steps) WHERE fault <> 0),
numbered AS (
  SELECT *, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    min(i) OVER (PARTITION BY conv_id, role, text) < i AS again
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged)),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM numbered),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
inserts AS (  -- states: 0 nothing yet, 1 after s, 2 after u, 3 after a
  SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (3, 2, 2, 'I', chr(10) || 'user:'),
    (2, 3, 2, 'I', chr(10) || 'assistant:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
    (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'))
    AS t(s, s_in, cost_in, audit_in, text_in)),
edits AS (
  SELECT * FROM (VALUES (0, 0, 'D', NULL, 3), (1, 1, 'D', NULL, 3), (2, 2, 'D', NULL, 3), (3, 3, 'D', NULL, 3),
    (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0),
    (0, 2, 'R', NULL, 2), (1, 2, 'R', NULL, 2), (3, 2, 'R', NULL, 2), (2, 3, 'R', NULL, 2))
    AS t(s_in, s_out, edit, wanted, cost_edit)),
dp AS (
  SELECT conv_id, 0 AS i, 0 AS s, {{'cost': 0, 'audit': '', 'text': ''}} AS best FROM facts
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, s_out, min({{
      'cost': best.cost + cost_in + cost_edit + (edit <> 'D' AND fault = 'truncated')::INT,
      'audit': best.audit || audit_in || edit,
      'text': best.text || text_in || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || f.text
        ELSE chr(10) || CASE s_out WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text END}})
  FROM dp JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
  JOIN inserts USING (s) JOIN edits USING (s_in)
  WHERE (edit = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (wanted IS NULL OR wanted = initial)
  GROUP BY dp.conv_id, dp.i, s_out),
ended AS (
  SELECT dp.conv_id, min({{'cost': best.cost + cost_in, 'audit': best.audit || audit_in, 'text': best.text || text_in}}) AS best
  FROM dp JOIN facts ON facts.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = facts.n JOIN inserts USING (s)
  WHERE s_in IN (0, 3) GROUP BY dp.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(best.text[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
"""

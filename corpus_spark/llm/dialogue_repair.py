"""Operator 12: conversation structure repair with Four-Russians block tables.

A conversation's rows are edited at the least cost so that their role initials read ``(s?(ua)+)?``. The
costs to go from each of the four states of that language, less their minimum, are one of a few dozen
vectors. A table takes every vector and every block of ``BLOCK`` rows to what the block adds and to the
vector before it; a conversation is processed from its end by one lookup a block. The trace goes forward:
each block is expanded backward from its right border into the vectors of its rows, and of the edits
that reach the least cost the one with the smallest letter is taken, so ties are decided exactly.

Rows are shuffled once, by conversation, and sorted by turn there (nulls first; equal turns by role and
text). A conversation is streamed through one task, because its result is one string and one digest over
all of its texts: a byte for each row and a digest for each different text stay in memory, texts beyond
64 MB wait in a file that the task deletes.

Null role and text are one space (so the row is blank); a null conv_id or turn is one space in the
damage's key, and null ids are one conversation. Empty texts are blank; very long ones are taken whole.
Repeated rows are duplicates. An empty table gives no rows. Other columns, whatever their names, have no
part in it.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows in a block of the tables.
BLOCK = 4
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States: nothing yet, after s, after u, after a. What a further u or a leads to; an insertion takes what fits.
_NEXT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
_FITS = ("u", "u", "a", "u")
_AFTER = (2, 2, 3, 2)
#: Symbols of rows: 0 must go; else 1 + 2 * place of the initial in this + 1 if truncated.
_INITIALS = "sua"
SYMBOLS = 1 + 2 * (len(_INITIALS) + 1)
_END = (0, 10, 5, 0)
_SPOOL = 64 << 20


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: every row after the damage; rows that it drops stay as gone, so that no conv_id is lost."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 0, "").otherwise(text).alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return out.select("conv_id", "turn", "role", "text", "gone", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")).drop("copy")


def _before(vector: tuple, symbol: int) -> tuple:
    """Costs to go before a row, from those after it."""
    role, cut = ("-", 0) if not symbol else ((_INITIALS + "-")[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2))
    best = []
    for state in range(4):
        costs = [DELETE + vector[state]]
        if symbol:
            costs.append(REROLE + cut + vector[_AFTER[state]])
            if (role, state) in _NEXT:
                costs.append(cut + vector[_NEXT[role, state]])
        best.append(min(costs))
    two, three = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
    return min(best[0], INSERT + two), min(best[1], INSERT + two), two, three


class Tables:
    """Vectors of costs to go, and their transitions by single symbols and by blocks of ``size``.

    ``act`` has, for the vector after a row, the row's symbol and the state before it, the letters of the edits
    up to that row and the state after it.
    """

    def __init__(self, size: int = BLOCK):
        ids, vectors, steps = {_END: 0}, [_END], []
        for vector in vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                found = _before(vector, symbol)
                low = min(found)
                normal = tuple(x - low for x in found)
                if normal not in ids:
                    ids[normal] = len(vectors)
                    vectors.append(normal)
                row.append((ids[normal], low))
            steps.append(row)
        self.vectors, self.size = vectors, size
        one = np.array(steps, dtype=np.int64)
        self.next, self.add = one[:, :, 0], one[:, :, 1]
        self.act = [[[self._act(v, s, state) for state in range(4)] for s in range(SYMBOLS)] for v in range(len(vectors))]
        block, cost = np.arange(len(vectors))[:, None], np.zeros((len(vectors), 1), dtype=np.int64)
        for _ in range(size):  # a further row in front: its symbol is the highest digit
            cost = np.concatenate([cost + self.add[block, s] for s in range(SYMBOLS)], axis=1)
            block = np.concatenate([self.next[block, s] for s in range(SYMBOLS)], axis=1)
        self.block, self.cost = block, cost
        self.digits = SYMBOLS ** np.arange(size - 1, -1, -1, dtype=np.int64)

    def _act(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        here, low, then = self.vectors[self.next[after, symbol]], int(self.add[after, symbol]), self.vectors[after]
        letters = ""
        while True:
            if DELETE + then[state] == low + here[state]:
                return letters + "D", state
            if INSERT + here[_AFTER[state]] == here[state]:
                letters, state = letters + "I", _AFTER[state]
                continue
            role, cut = (_INITIALS + "-")[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
            if (role, state) in _NEXT and cut + then[_NEXT[role, state]] == low + here[state]:
                return letters + "K", _NEXT[role, state]
            return letters + "R", _AFTER[state]

    def repair(self, symbols: np.ndarray) -> tuple[int, str]:
        """The least cost, and the ASCII-least of the audits that have it."""
        symbols = np.asarray(symbols, dtype=np.int64)
        odd = len(symbols) % self.size
        codes = symbols[odd:].reshape(-1, self.size) @ self.digits
        borders, v, cost = [0], 0, 0  # vectors to the right of each block, from the last one
        for code in codes[::-1].tolist():
            cost += int(self.cost[v, code])
            v = int(self.block[v, code])
            borders.append(v)
        out, state = [], 0

        def expand(part: list[int], right: int, state: int) -> tuple[int, int, int]:
            """Writes the edits of a few rows; returns the state after them, the vector before them and what they add."""
            after, v, more = [], right, 0
            for s in reversed(part):
                after.append(v)
                more += int(self.add[v, s])
                v = int(self.next[v, s])
            for s in part:
                letters, state = self.act[after.pop()][s][state]
                out.append(letters)
            return state, v, more

        state, v, more = expand(symbols[:odd].tolist(), v, state)
        cost += more + self.vectors[v][0]
        for k, part in enumerate(symbols[odd:].reshape(-1, self.size).tolist()):
            state = expand(part, borders[len(codes) - 1 - k], state)[0]
        out.append("I" * (_END[state] // INSERT))
        return cost, "".join(out)


@lru_cache(maxsize=4)
def tables(size: int = BLOCK) -> Tables:
    return Tables(size)


_STOPS = frozenset(".!?")
_SPACE = " \t\n\x0b\x0c\r"


class _Conversation:
    """What is kept of a conversation while its rows are streamed."""

    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.seen = conv_id, bytearray(), set()
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.texts = None
        self.initial = None

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.low, self.high, self.last, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        trimmed, initial = text.rstrip(_SPACE), role[:1]
        own = f"{role}\0{text}".encode("utf-8", "surrogatepass")
        key = hashlib.blake2b(own, digest_size=16).digest()
        symbol = 1 + 2 * ("sua".find(initial) if initial and initial in _INITIALS else 3)
        if not trimmed:
            self.blank += 1
            symbol = 0
        elif key in self.seen:
            self.duplicate += 1
            symbol = 0
        elif trimmed[-1] not in _STOPS:
            self.truncated += 1
            symbol += 1
        self.seen.add(key)
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        self.symbols.append(symbol)
        if symbol:
            if self.texts is None:
                self.texts = tempfile.SpooledTemporaryFile(max_size=_SPOOL)
            self.texts.write(len(role.encode("utf-8", "surrogatepass")).to_bytes(4, "little") + len(own).to_bytes(8, "little") + own)

    def result(self) -> dict:
        cost, audit = tables().repair(np.frombuffer(bytes(self.symbols), dtype=np.uint8))
        digest, state, row, first = hashlib.sha256(), 0, 0, True
        if self.texts is not None:
            self.texts.seek(0)
        for letter in audit:
            line = None
            if letter == "I":
                line = b"user:" if _FITS[state] == "u" else b"assistant:"
                state = _AFTER[state]
            else:
                symbol = self.symbols[row]
                row += 1
                if symbol:
                    role_size, size = int.from_bytes(self.texts.read(4), "little"), int.from_bytes(self.texts.read(8), "little")
                    own = self.texts.read(size)
                if letter == "R":
                    line = (b"user:" if _FITS[state] == "u" else b"assistant:") + own[role_size + 1 :]
                    state = _AFTER[state]
                elif letter == "K":
                    line = own[:role_size] + b":" + own[role_size + 1 :]
                    state = _NEXT[(_INITIALS + "-")[(symbol - 1) // 2], state]
            if line is not None:
                digest.update(line if first else b"\n" + line)
                first = False
        if self.texts is not None:
            self.texts.close()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()}


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of rows with conv_id, turn, role, text.

    A row with a true ``gone``, if there is such a column, only names its conversation.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("gone"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in parts:
            names = pa.schema([("conv_id", batch.schema.field("conv_id").type), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for conv, turn, role, text, gone in zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone"))):
                    if now is None or conv != now.conv_id:
                        if now is not None:
                            done.append(now.result())
                        now = _Conversation(conv)
                    if not gone:
                        now.add(turn, role, text)
                if len(done) >= 1000:
                    yield pa.RecordBatch.from_pylist(done, schema=names)
                    done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([*done, now.result()], schema=names)

    return dealt.mapInArrow(run, schema)


def _sql_steps() -> str:
    """The costs to go before a row, one expression for each state, from g[1] to g[4] after it."""
    out = []
    for state in range(4):
        keep = " ".join(f"WHEN c = '{role}' THEN cut + g[{to + 1}]" for (role, at), to in _NEXT.items() if at == state)
        out.append(f"CASE WHEN gone THEN 2 + g[{state + 1}] ELSE least(2 + g[{state + 1}], 1 + cut + g[{_AFTER[state] + 1}], CASE {keep} ELSE 1000000000 END) END")
    return ", ".join(out)


#: The same in DuckDB: costs to go row by row from the end, then the edits row by row from the start.
SQL = rf"""
WITH RECURSIVE table_ AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)),
             lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 20 AS h FROM k, table_),
every AS (SELECT DISTINCT conv_id FROM h),
n AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM n),
f AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS trimmed, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS c0 FROM o),
r AS (SELECT *, trimmed = '' AS is_blank, trimmed <> '' AND again AS is_dup, trimmed <> '' AND NOT again AND NOT regexp_matches(trimmed, '[.!?]$') AS is_cut,
             trimmed = '' OR again AS gone FROM f),
m AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (is_blank) AS blank,
             count(*) FILTER (is_dup) AS duplicate, count(*) FILTER (is_cut) AS truncated,
             count(*) FILTER (c0 IS NOT NULL AND c0 || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
back AS (
  SELECT conv_id, n AS i, [0, 10, 5, 0]::BIGINT[] AS g FROM m
  UNION ALL
  SELECT conv_id, i, [least(b[1], 5 + least(b[3], 5 + b[4])), least(b[2], 5 + least(b[3], 5 + b[4])), least(b[3], 5 + b[4]), least(b[4], 5 + b[3])]
  FROM (SELECT back.conv_id, back.i - 1 AS i, [{_sql_steps()}]::BIGINT[] AS b
        FROM (SELECT *, CASE WHEN is_cut THEN 5 ELSE 0 END AS cut FROM r) q JOIN back ON q.conv_id IS NOT DISTINCT FROM back.conv_id AND q.i = back.i)),
side AS (SELECT b.conv_id, b.i, b.g, nx.g AS g1, r.role, r.text, r.c, r.gone, CASE WHEN r.is_cut THEN 5 ELSE 0 END AS cut
         FROM back b LEFT JOIN back nx ON nx.conv_id IS NOT DISTINCT FROM b.conv_id AND nx.i = b.i + 1
         LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1),
forth AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, ''::VARCHAR AS audit, []::VARCHAR[] AS lines FROM m
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
         CASE WHEN e = 'D' THEN state WHEN e = 'K' AND c = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END, audit || e,
         CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                WHEN 'I' THEN list_append(lines, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END)
                ELSE list_append(lines, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || text) END
  FROM (SELECT x.*, s.role, s.text, s.c,
               CASE WHEN g1 IS NOT NULL AND 2 + g1[state + 1] = g[state + 1] THEN 'D'
                    WHEN 5 + g[CASE WHEN state = 2 THEN 4 ELSE 3 END] = g[state + 1] THEN 'I'
                    WHEN g1 IS NULL THEN 'E'
                    WHEN c = 's' AND state = 0 AND cut + g1[2] = g[1] OR c = 'u' AND state <> 2 AND cut + g1[3] = g[state + 1] OR c = 'a' AND state = 2 AND cut + g1[4] = g[3] THEN 'K'
                    ELSE 'R' END AS e
        FROM forth x JOIN side s ON s.conv_id IS NOT DISTINCT FROM x.conv_id AND s.i = x.i) WHERE e <> 'E'),
last AS (SELECT conv_id, max_by(audit, len(audit)) AS audit, max_by(lines, len(audit)) AS lines FROM forth GROUP BY conv_id)
SELECT e.conv_id, coalesce(m.gaps, 0) AS gaps, coalesce(m.blank, 0) AS blank, coalesce(m.duplicate, 0) AS duplicate, coalesce(m.truncated, 0) AS truncated,
       coalesce(m.illegal, 0) AS illegal, coalesce(b.g[1], 0) AS cost, coalesce(l.audit, '') AS audit, sha256(coalesce(array_to_string(l.lines, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN last l ON l.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND b.i = 0
"""

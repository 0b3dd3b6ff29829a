"""Conversation structure repair by a dynamic program over persistent edit strings.

A conversation's rows are edited so that the roles read ``(s?(ua)+)?``. After each row
the program holds, for each of the four states of that pattern, the cheapest edits so
far, ties going to the ASCII-least string of edit initials. Edit strings share their
prefixes: a node is one edit and a link to the edits before it, with binary-lifting
ancestors and a rolling hash of the whole string. Two strings of equal cost are compared
by searching their longest common prefix over the ancestors' hashes; the prefix found is
then verified edit by edit down to the first shared node.

Steps are associative, so a long conversation is no single task's work: rows are dealt
out by range in conversation order, a task cuts what it holds of a conversation into
parts of at most ``PART`` rows, and a part is solved from every state. Parts of one
conversation then meet as four-by-four tables. Only its surviving lines pass through one
task, as a stream in order, since their digest is sequential.

Null role, text, turn or conv_id count as one space in what is hashed or compared; a null
turn sorts first and takes no part in gaps. Rows of one turn are ordered by role and text.
Repeated rows are counted before anything is sorted; each but the first is a duplicate.
Further columns are ignored. Empty tables give no rows. Texts of any length pass whole.
"""

import functools
import hashlib
import json

from pyspark import TaskContext
from pyspark.sql import functions as F

from ledgerlark.llm.common import arrow_schema, batch_of_rows, lists
from ledgerlark.plans import lineage

#: Rows of a conversation that are solved as one part.
PART = 4096
#: Lines in a record batch that a task gives back.
ROWS_OUT = 2000

#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
FORWARD = [USER, USER, ASSISTANT, USER]
ROLES = {USER: "user", ASSISTANT: "assistant"}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}

_BASE, _MODULUS = 911_382_323, (1 << 61) - 1


class Edits:
    """Edit strings as nodes 0 (empty), 1, 2, ...; ``more`` appends one edit to a node."""

    def __init__(self):
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def more(self, node, edit):
        above = [node]
        while len(self.up[above[-1]]) >= len(above):
            above.append(self.up[above[-1]][len(above) - 1])
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(edit)) % _MODULUS)
        self.up.append(tuple(above))
        return len(self.edit) - 1

    def text(self, node):
        found = []
        while node:
            found.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(found))

    def _at_depth(self, node, depth):
        while self.depth[node] > depth:
            climb = (self.depth[node] - depth).bit_length() - 1
            node = self.up[node][climb]
        return node

    def less(self, a, b):
        """Whether the string of node ``a`` is the smaller one."""
        if a == b:
            return False
        depth = min(self.depth[a], self.depth[b])
        x, y = self._at_depth(a, depth), self._at_depth(b, depth)
        if self.hash[x] == self.hash[y]:
            if self._same(x, y):
                return self.depth[a] < self.depth[b]
            return self.text(a) < self.text(b)
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self.edit[x] == self.edit[y] or not self._same(self.up[x][0], self.up[y][0]):
            return self.text(a) < self.text(b)
        return self.edit[x] < self.edit[y]

    def _same(self, x, y):
        """Whether strings of one length are equal, edit by edit down to the first shared node."""
        while x != y:
            if self.edit[x] != self.edit[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True


def _offer(edits, best, state, cost, node):
    held = best[state]
    if held is None or cost < held[0] or cost == held[0] and edits.less(node, held[1]):
        best[state] = (cost, node)


def _inserted(edits, best):
    """The states that empty rows lead to, inserted behind what is there."""
    for _ in range(2):
        for state, held in enumerate(list(best)):
            if held:
                _offer(edits, best, FORWARD[state], held[0] + COST["I"], edits.more(held[1], "I"))
    return best


def _after(edits, best, initial, gone, cut):
    """The best edits of each state after one more row."""
    found = [None] * 4
    for state, held in enumerate(best):
        if held is None:
            continue
        cost, node = held
        _offer(edits, found, state, cost + COST["D"], edits.more(node, "D"))
        if not gone:
            kept = KEEP[state].get(initial)
            if kept is not None:
                _offer(edits, found, kept, cost + cut, edits.more(node, "K"))
            _offer(edits, found, FORWARD[state], cost + COST["R"] + cut, edits.more(node, "R"))
    return _inserted(edits, found)


def solve(rows, start, first):
    """(cost, edits) for each end state from the state ``start``, or None. ``rows``:
    (initial, must go, truncated). ``first``: rows may be inserted before the first one."""
    edits = Edits()
    best = [None] * 4
    best[start] = (0, 0)
    if first:
        best = _inserted(edits, best)
    for row in rows:
        best = _after(edits, best, *row)
    return [held and (held[0], edits.text(held[1])) for held in best]


def ended(best):
    """The cheapest of the states a conversation may end in."""
    return min(held for held in (best[START], best[ASSISTANT]) if held)


def lines_of(audit, rows, state=START):
    """The repaired lines of (role, text) rows, and at last the state reached. Rows are drawn only by edits
    of rows, so ``rows`` may be a stream."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        state = KEEP[state][role[:1]] if edit == "K" else FORWARD[state]
        yield f"{role}:{text}" if edit == "K" else f"{ROLES[state]}:{text}"


class Digest:
    """The sha256 of lines joined by a line feed."""

    def __init__(self):
        self.state, self.some = hashlib.sha256(), False

    def add(self, line):
        if self.some:
            self.state.update(b"\n")
        self.some = True
        self.state.update(line.encode("utf-8", "surrogatepass"))


class Part:
    """Rows of one conversation that follow each other: counts, and what the edits need."""

    def __init__(self):
        self.rows, self.lines = [], []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns = self.least = self.most = self.last_turn = None
        self.first_role = self.last_role = None

    def add(self, turn, role, text, fault):
        initial = role[:1]
        if fault:
            self.counts[fault] += 1
        if self.rows:
            self.counts["illegal"] += (self.last_role + initial) not in ("su", "ua", "au")
        else:
            self.first_role = initial
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.turns = (self.turns or 0) + 1
            self.least = turn if self.least is None else self.least
            self.most = self.last_turn = turn
        self.rows.append((initial, fault in ("blank", "duplicate"), fault == "truncated"))
        self.lines.append((role, text))

    def table(self):
        """Everything but the lines, as plain values."""
        return self.counts | {
            "turns": [self.turns, self.least, self.most],
            "roles": [self.first_role, self.last_role],
            "rows": len(self.rows),
            "best": [solve(self.rows, start, False) for start in range(4)],
        }


_DONE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SOLVED = f"kind int, part long, line long, body string, {_DONE}"


def _done_row(conv_id, turns, counts, best, digest):
    found, least, most = turns
    return (conv_id, most - least + 1 - found if found else 0, *(counts[k] for k in ("blank", "duplicate", "truncated", "illegal")), *best, digest)


def _whole(conv_id, part):
    cost, audit = ended(solve(part.rows, START, True)) if part.rows else (0, "")
    digest = Digest()
    for line in lines_of(audit, part.lines):
        digest.add(line)
    return _done_row(conv_id, (part.turns, part.least, part.most), part.counts, (cost, audit), digest.state.hexdigest())


def _parts(batches, most):
    """Rows of a partition as (conv_id, its parts, whether it may go on in another partition)."""
    names = ("conv_id", "turn", "role", "text", "copies", "blank", "cut", "seen")
    held, parts, count, first = None, None, 0, True
    for records in batches:
        for conv_id, turn, role, text, copies, blank, cut, seen in zip(*lists(records, *names)):
            if parts is None or conv_id != held:
                if parts is not None:
                    yield held, parts, first
                    first = False
                held, parts = conv_id, [Part()]
            for copy in range(copies):
                if len(parts[-1].rows) == most:
                    parts.append(Part())
                parts[-1].add(turn, role, text, "blank" if blank else "duplicate" if seen or copy else "truncated" if cut else None)
    if parts is not None:
        yield held, parts, True


def _solve_partition(batches, most):
    """Conversations inside a partition are solved here; those at its ends and long ones
    are given back as parts and lines."""
    schema = arrow_schema(_SOLVED)
    place, rows, order = TaskContext.get().partitionId(), [], 0
    for conv_id, parts, at_end in _parts(batches, most):
        if not at_end and len(parts) == 1:
            rows.append((2, None, None, None, *_whole(conv_id, parts[0])))
        else:
            for part in parts:
                order += 1
                key = (place << 32) + order
                blank = (None,) * 8
                rows.append((0, key, 0, json.dumps(part.table()), conv_id, *blank))
                for k, (line, row) in enumerate(zip(part.lines, part.rows)):
                    if not row[1]:
                        rows.append((1, key, k, json.dumps(line), conv_id, *blank))
        if len(rows) >= ROWS_OUT:
            yield batch_of_rows(schema, rows)
            rows = []
    if rows:
        yield batch_of_rows(schema, rows)


def _chained(tables):
    """The cheapest edits through all parts: cost, and for each part its state at the start
    and its edits. A way is (way so far, edits, state); compared ways stand behind the same part."""
    best = [held and (held[0], (None, held[1], START)) for held in solve([], START, True)]
    for table in tables:
        found = [None] * 4
        for start, held in enumerate(best):
            for end, step in enumerate(table["best"][start] if held else ()):
                if step:
                    found[end] = _cheaper(found[end], (held[0] + step[0], (held[1], step[1], start)))
        best = found
    cost, way = _cheaper(best[START], best[ASSISTANT])
    steps = []
    while way:
        steps.append((way[2], way[1]))
        way = way[0]
    return cost, steps[::-1]


def _cheaper(a, b):
    if a is None or b is None or a[0] != b[0]:
        return min(filter(None, (a, b)), key=lambda held: held[0])
    return b if _apart(b[1], a[1]) < _apart(a[1], b[1]) else a


def _apart(way, other):
    """The edits of ``way`` behind what it shares with ``other``."""
    found = []
    while way is not other:
        found.append(way[1])
        way, other = way[0], other[0]
    return "".join(reversed(found))


def _join_parts(batches):
    """Parts of split conversations, each conversation's parts before its lines, both in order."""
    schema = arrow_schema(_DONE)
    held, state = None, None

    def close():
        return batch_of_rows(schema, [state.row(held)])

    for records in batches:
        for kind, conv_id, part, line, body in zip(*lists(records, "kind", "conv_id", "part", "line", "body")):
            if state is None or conv_id != held:
                if state is not None:
                    yield close()
                held, state = conv_id, _Joined()
            if kind == 0:
                state.tables.append((part, json.loads(body)))
            else:
                state.line(part, line, json.loads(body))
    if state is not None:
        yield close()


class _Joined:
    """A split conversation: first its parts, then its lines as they come."""

    def __init__(self):
        self.tables, self.digest, self.steps = [], Digest(), None

    def _reach(self, step):
        """Ends the steps before ``step``; step 0 stands before all parts."""
        if self.steps is None:
            self.cost, self.steps = _chained([table for _, table in self.tables])
            self.place = {part: k for k, (part, _) in enumerate(self.tables, 1)}
            self.at, self.writer = 0, _Writer(*self.steps[0], self.digest)
        while self.at < step:
            self.writer.finish()
            self.at += 1
            self.writer = _Writer(*self.steps[self.at], self.digest)

    def line(self, part, index, row):
        self._reach(0)
        self._reach(self.place[part])
        self.writer.row(index, *row)

    def row(self, conv_id):
        self._reach(len(self.tables))
        self.writer.finish()
        counts = {k: sum(table[k] for _, table in self.tables) for k in ("blank", "duplicate", "truncated", "illegal")}
        turns, least, most, last_role = 0, None, None, None
        for _, table in self.tables:
            found, low, high = table["turns"]
            if found:
                turns += found - (most == low)
                least, most = low if least is None else least, high
            if table["rows"]:
                first_role, end_role = table["roles"]
                counts["illegal"] += last_role is not None and (last_role + first_role) not in ("su", "ua", "au")
                last_role = end_role
        audit = "".join(edits for _, edits in self.steps)
        return _done_row(conv_id, (turns, least, most), counts, (self.cost, audit), self.digest.state.hexdigest())


class _Writer:
    """Applies the edits of one part to its rows, of which those that must go are left out."""

    def __init__(self, state, edits, digest):
        self.state, self.edits, self.digest, self.at, self.index = state, edits, digest, 0, 0

    def _upto(self, index):
        """Applies edits until the next one is that of row ``index``."""
        while self.at < len(self.edits) and (self.index < index or self.edits[self.at] == "I"):
            edit = self.edits[self.at]
            self.at += 1
            if edit == "I":
                self.state = FORWARD[self.state]
                self.digest.add(f"{ROLES[self.state]}:")
            else:
                self.index += 1  # a row that must go

    def row(self, index, role, text):
        self._upto(index)
        edit = self.edits[self.at]
        self.at += 1
        self.index += 1
        if edit == "D":
            return
        self.state = KEEP[self.state][role[:1]] if edit == "K" else FORWARD[self.state]
        self.digest.add(f"{role if edit == 'K' else ROLES[self.state]}:{text}")

    def finish(self):
        self._upto(len(self.edits))


_SPACES = r"\x20\x09-\x0D"


def damage(conversations):
    """The rows after the planted damage, equal ones counted; a dropped row has 0 copies."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fate"))
    fate = F.col("fate")
    return rows.select(
        "conv_id",
        "turn",
        F.when(fate == 0, "").when(fate == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fate.isin(0, 1), "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows, part=PART):
    """Audit and repair of conversations in ``rows`` (conv_id, turn, role, text without
    nulls, copies): one row per conv_id, those whose rows all have 0 copies included.

    Counts of faults and gaps, the cost and initials of the cheapest edits, and the digest
    of the repaired lines. ``part``: rows solved together."""
    # no rows of a conversation but one of each kind, however often they are repeated
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    rows = rows.withColumns(
        {
            "blank": ~F.col("text").rlike(f"[^{_SPACES}]"),
            "cut": ~F.col("text").rlike(f"[.!?][{_SPACES}]*\\z"),
            "message": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256),
            "moment": F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")),
        }
    )
    again = rows.filter("copies > 0").groupBy("conv_id", "message").agg(F.min("moment").alias("first"), F.count("*").alias("n"))
    again = again.filter("n > 1").select(F.col("conv_id").alias("c"), F.col("message").alias("m"), "first")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("message") == F.col("m")), "left")
    rows = rows.withColumn("seen", F.coalesce(F.col("moment") > F.col("first"), F.lit(False))).withColumn("head", F.substring("text", 1, 32))
    order = ["conv_id", "turn", "role", "head"]
    wanted = ["conv_id", "turn", "role", "head", "text", "copies", "blank", "cut", "seen"]
    ordered = rows.select(*wanted).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    solved = lineage.cut(ordered.mapInArrow(functools.partial(_solve_partition, most=part), _SOLVED), "audits")
    split = solved.filter("kind < 2").select("kind", "conv_id", "part", "line", "body")
    joined = split.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "line").mapInArrow(_join_parts, _DONE)
    names = [field.split()[0] for field in _DONE.split(", ")]
    return solved.filter("kind = 2").select(*names).union(joined)


def audits(conversations, part=PART):
    """Damage, then repair."""
    return repair(damage(conversations), part)

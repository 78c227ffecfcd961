"""Conversation structure repair: the cheapest edits by a Viterbi scan whose survivors coalesce."""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from placeweave.llm.native import fresh, read

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What may stand before a turn of the user, and before one of the assistant: nothing yet, a system turn, …
START, SYSTEM, USER, ASSISTANT = range(4)
BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
SOLID = re.compile(r"[^\x20\x09-\x0D]")
SPACES = " \t\n\x0b\x0c\r"
FLUSH_ROWS = 2000


class Step:
    """A node of the backpointer tree: one edit after those of its parent.

    ``kids`` are the steps that build on it and ``held`` tells that it is a survivor itself; their number is its
    reference count. A step without any leaves the tree.
    """

    __slots__ = ("parent", "kids", "held", "depth", "letter", "made")

    def __init__(self, parent, letter, made):
        self.parent, self.letter, self.made = parent, letter, made
        self.kids, self.held = [], False
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.kids.append(self)

    def release(self):
        step = self
        while step.parent and not step.held and not step.kids:
            above = step.parent
            above.kids.remove(step)
            step.parent, step = None, above


def earlier(one, letter_one, two, letter_two):
    """Whether the edits up to ``one`` and a letter come before those up to ``two`` and a letter, in ASCII order.

    Both suffixes are compared whole, from the step where they part.
    """
    left, right = [letter_one], [letter_two]
    while one is not two:
        if one.depth >= two.depth:
            left.append(one.letter)
            one = one.parent
        else:
            right.append(two.letter)
            two = two.parent
    return left[::-1] < right[::-1]


class Repair:
    """Edits of one conversation, row by row; ``done`` gets each edit as soon as no other can win.

    After each row every state keeps one survivor: the cheapest edits that lead to it, ties ASCII-least. Survivors of
    equal cost never are prefixes of each other (more inserts cost more), so the order of two is final. A survivor that
    another beats whatever follows is dropped: whatever a path does after START or SYSTEM, one after ASSISTANT can do,
    with a deletion instead of a kept system turn. Edits that all survivors share are final and leave the tree, so only
    the unresolved suffix is held.
    """

    def __init__(self, done):
        self.done = done
        self.root = Step(None, "", None)
        self.root.held = True
        self.live = {START: (0, self.root)}
        self.insertions(self.live)

    def offer(self, best, state, cost, parent, letter, made):
        found = best.get(state)
        if found is None or cost < found[0] or cost == found[0] and earlier(parent, letter, found[1], found[2]):
            best[state] = (cost, parent, letter, made)

    def insertions(self, live):
        """Reach further states from the survivors by inserted turns: first the user's, then the assistant's."""
        for state in (USER, ASSISTANT):
            best = {}
            for old in BEFORE[state]:
                if old in live:
                    cost, step = live[old]
                    self.offer(best, state, cost + INSERT, step, "I", ("I", None, ROLES[state], "", None, False))
            if state in best:
                cost, parent, letter, made = best[state]
                now = live.get(state)
                if now is None or cost < now[0] or cost == now[0] and earlier(parent, letter, now[1].parent, now[1].letter):
                    step = Step(parent, letter, made)
                    step.held = True
                    if now is not None:
                        now[1].held = False
                        now[1].release()
                    live[state] = (cost, step)

    def row(self, turn, role, text, fault, illegal):
        stays = TRUNCATED if fault == "truncated" else 0
        best = {}
        for state, (cost, step) in self.live.items():
            self.offer(best, state, cost + DELETE, step, "D", ("D", turn, role, text, fault, illegal))
            if fault in ("blank", "duplicate"):
                continue
            for new, old in BEFORE.items():
                if state in old:
                    letter, role_now, price = ("K", role, KEEP) if role[:1] == ROLES[new][0] else ("R", ROLES[new], REROLE)
                    self.offer(best, new, cost + price + stays, step, letter, (letter, turn, role_now, text, fault, illegal))
            if state == START and role[:1] == "s":
                self.offer(best, SYSTEM, cost + KEEP + stays, step, "K", ("K", turn, role, text, fault, illegal))
        before, self.live = self.live, {}
        for state, (cost, parent, letter, made) in best.items():
            step = Step(parent, letter, made)
            step.held = True
            self.live[state] = (cost, step)
        for _, step in before.values():
            step.held = False
            step.release()
        self.insertions(self.live)
        self.drop_beaten()
        self.settle()

    def drop_beaten(self):
        cost, step = self.live[ASSISTANT]
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if state in self.live:
                other, loser = self.live[state]
                if other > cost + more or state == SYSTEM and other == cost and earlier(step, "", loser, ""):
                    del self.live[state]
                    loser.held = False
                    loser.release()

    def settle(self):
        """Hand over the edits that all survivors share."""
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent.kids.clear()
            self.root.parent = None
            self.done(self.root.made)

    def end(self):
        """Only no turn at all and an assistant's turn may come last."""
        cost, step = self.live[ASSISTANT]
        if START in self.live:
            other, empty = self.live[START]
            if other < cost or other == cost and earlier(empty, "", step, ""):
                step = empty
        rest = []
        while step is not self.root:
            rest.append(step.made)
            step = step.parent
        for made in reversed(rest):
            self.done(made)


def fault_of(text, again):
    """The first fault of a row."""
    if not SOLID.search(text):
        return "blank"
    if again:
        return "duplicate"
    return "truncated" if text.rstrip(SPACES)[-1] not in ".!?" else None


def by_conversation(batches, columns, begin, row, end):
    """Call ``begin()`` for each run of equal keys, ``row(state, key, values)`` for its rows, ``end(state, key)`` after them.

    The first column is the key. Rows stream: nothing of a conversation is kept here but its state.
    """
    at, state = (), None
    for batch in batches:
        for key, *values in zip(*(batch.column(c).to_pylist() for c in columns)):
            if at != (key,):
                if at:
                    yield from end(state, *at)
                at, state = (key,), begin()
            yield from row(state, key, values)
    if at:
        yield from end(state, *at)


def in_batches(rows, schema):
    """Arrow batches of FLUSH_ROWS tuples."""
    some = []
    for r in rows:
        some.append(r)
        if len(some) == FLUSH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


EDITS = "conv_id {0}, step long, edit string, turn long, role string, text string, fault string, illegal boolean"


def repair(df: DataFrame, key="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row for each edit of each conversation, in order: conv_id, step (from 0), edit (K, R, D or I), turn, role, text, fault, illegal.

    The rows that are not deleted are the repaired conversation: roles start with ``(s?(ua)+)?``. Costs are KEEP, REROLE,
    DELETE (required for blank and duplicate rows) and INSERT of an empty turn; a truncated row that stays costs
    TRUNCATED. The cheapest edits win; of several, those whose letters come first in ASCII order. ``role`` is the new
    role, of a deleted row its own. ``fault`` is the row's first fault: blank (white space only), duplicate (role and
    text stood earlier), truncated (last solid character is not one of ``.!?``), or null. ``illegal`` tells that the
    initials of the row before and of this one are not su, ua or au.

    Conversations are dealt out whole and sorted; rows then stream through the scan, and only the unresolved edits are
    held, so that a long conversation needs time but not memory. Rows are taken by turn (nulls first), ties by
    role, then text. Null roles and texts count as one space; a null key is a conversation of its own. Repeated rows
    are duplicates. A role whose initial is none of s, u and a can only be changed or deleted. An empty table gives no rows.
    """
    fresh(df, key, turn, role, text)
    kind = dict(df.select(F.col(key)).dtypes)[key]
    rows = df.select(
        F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    alike = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    rows = (
        rows.repartition("conv_id").withColumn("nth", F.row_number().over(alike))
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "nth")
        .select("conv_id", "turn", "role", "text", (F.col("nth") > 1).alias("again"))
    )

    def begin():
        made = []
        return {"made": made, "scan": Repair(made.append), "last": None, "n": 0}

    def given(state, conv):
        for x in state["made"]:
            yield conv, state["n"], *x
            state["n"] += 1
        state["made"].clear()

    def row(state, conv, values):
        turn, role, text, again = values
        illegal = state["last"] is not None and state["last"] + role[:1] not in LEGAL
        state["last"] = role[:1]
        state["scan"].row(turn, role, text, fault_of(text, again), illegal)
        yield from given(state, conv)

    def end(state, conv):
        state["scan"].end()
        yield from given(state, conv)

    def run(batches):
        batches = iter(batches)
        for first in batches:
            kinds = (first.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
            names = ("conv_id", "step", "edit", "turn", "role", "text", "fault", "illegal")
            every = (b for some in ([first], batches) for b in some)
            found = by_conversation(every, ("conv_id", "turn", "role", "text", "again"), begin, row, end)
            yield from in_batches(found, pa.schema(list(zip(names, kinds))))

    return rows.mapInArrow(run, EDITS.format(kind))


SUMMARY = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summary(edits: DataFrame) -> DataFrame:
    """Counts, cost, letters of the edits and sha256 of the repaired rows of each conversation of ``repair``.

    The rows of ``repair`` are read in the order in which it gives them, without another shuffle.
    """
    kind = dict(edits.dtypes)["conv_id"]

    def begin():
        return {"counts": {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, "cost": 0, "audit": [], "sha": hashlib.sha256(), "rows": 0, "turns": []}

    def row(state, conv, values):
        edit, turn, role, text, fault, illegal = values
        state["audit"].append(edit)
        state["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
        if fault:
            state["counts"][fault] += 1
        state["counts"]["illegal"] += illegal
        if turn is not None:
            least, last, n = state["turns"] or (turn, None, 0)
            state["turns"] = (least, turn, n + (turn != last))
        if edit != "D":
            state["sha"].update(("\n" * bool(state["rows"]) + f"{role}:{text}").encode())
            state["rows"] += 1
        return ()

    def end(state, conv):
        least, last, n = state["turns"] or (0, 0, 1)
        yield conv, last - least + 1 - n, *state["counts"].values(), state["cost"], "".join(state["audit"]), state["sha"].hexdigest()

    def run(batches):
        batches = iter(batches)
        for first in batches:
            names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
            kinds = (first.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string())
            every = (b for some in ([first], batches) for b in some)
            found = by_conversation(every, ("conv_id", "edit", "turn", "role", "text", "fault", "illegal"), begin, row, end)
            yield from in_batches(found, pa.schema(list(zip(names, kinds))))

    return edits.select("conv_id", "edit", "turn", "role", "text", "fault", "illegal").mapInArrow(run, SUMMARY.format(kind))


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with known faults, chosen by the crc32 of ``conv_id:turn`` (nulls: one space) mod 20."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("fate"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("fate <> 0").select(
        "conv_id", "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    )


def run(spark, sf_dir):
    """Repair of damaged conversations; one that has lost all its rows has zeros and empty texts."""
    given = read(spark, sf_dir, "conversations")
    found = summary(repair(damaged(given)))
    every = given.select(F.col("conv_id").alias("every")).distinct()
    joined = every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select(
        F.col("every").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )

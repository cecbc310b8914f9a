"""Structure repair of conversations: the cheapest edits that leave an optional system turn and then user and assistant by turns.

Window functions flag each turn's first fault, a conversation's sorted turns are collected, and aggregate() folds them: the accumulator holds four (cost, audit) structs, one for
each role that the repaired conversation may end in so far (none, system, user, assistant), and least() keeps the better of two. All of it is SQL functions.

Edits of a turn: Keep (0), Rerole to user or assistant (3), Delete (4; the only one for blank and duplicate turns); an Insert of an empty user or assistant turn may stand anywhere (3). A
truncated turn that is not deleted costs 3 more. Of equal costs the audit that is least in ASCII wins. In the fold I, J and R, S are inserts and reroles to user and assistant: wherever two audits first differ, the state is the
same, from which one of I and J (and of R and S) alone is legal, so this order is that of the plain letters.

Cases: a null role or text is one space, so it is blank or of no known role. Turns are ordered by turn (nulls first), then role, then text. A null conv_id is a conversation of its own. Repeated rows are duplicates.
An empty table gives no rows. A role counts by its first letter. A conversation is one row of the result with one digest of its whole text, so its turns meet in one task; whole conversations are the largest
unit that is ever gathered. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Cost of what cannot be reached.
NEVER = 1 << 60
BLANK = r"[^\x20\x09-\x0D]"
STATES = ("none", "system", "user", "assistant")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: by crc32 of conv_id:turn modulo 20, a row is dropped (0 copies), emptied, stripped of its sentence ends, repeated (2 copies) or made the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    own = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), case.alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("case") == 0, 0).when(F.col("case") == 3, 2).otherwise(1)
    return own.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _flagged(turns: DataFrame, copies: str | None) -> DataFrame:
    """A row for each standing turn with its flags; of rows with no copies one that does not stand, so that its conversation is known. Both windows and the later grouping use one shuffle."""
    n = F.col(copies) if copies else F.lit(1)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.explode(F.when(n < 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), n.cast("int")))).alias("copy"))
    rows = rows.withColumn("stands", F.col("copy") > 0).withColumn("initial", F.when(F.col("stands"), F.substring("role", 1, 1)))
    within = Window.partitionBy("conv_id").orderBy("stands", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    same = Window.partitionBy("conv_id", "stands", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    rows = rows.withColumn("before", F.lag("initial").over(within)).withColumn("nth", F.row_number().over(same))
    blank = ~F.col("text").rlike(BLANK)
    duplicate = ~blank & (F.col("nth") > 1)
    truncated = ~blank & ~duplicate & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    flag = lambda c, name: (F.col("stands") & c).alias(name)
    return rows.select("conv_id", "turn", "role", "text", "initial", "stands", flag(blank, "blank"), flag(duplicate, "duplicate"), flag(truncated, "truncated"), flag(illegal, "illegal"))


def _path(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _after(path: Column, cost: Column | int, letter: str) -> Column:
    return _path(path["cost"] + cost, F.concat(path["audit"], F.lit(letter)))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _closed(paths: Column) -> Column:
    """The four paths after inserts, of which two in a row are the most that can help."""
    none, system, user, assistant = (paths[s] for s in STATES)
    to_user = _let(F.least(none, system, assistant), lambda p: F.least(user, _after(p, INSERT, "I")))
    return _let(to_user, lambda p: F.struct(none.alias("none"), system.alias("system"), p.alias("user"), F.least(assistant, _after(p, INSERT, "J")).alias("assistant")))


def _cheapest(turns: Column) -> Column:
    """The cheapest (cost, audit) of sorted turns."""
    never = _path(F.lit(NEVER), F.lit(""))
    four = lambda *paths: F.struct(*(p.alias(s) for p, s in zip(paths, STATES, strict=True)))

    def step(paths: Column, turn: Column) -> Column:
        none, system, user, assistant = (paths[s] for s in STATES)
        cut = F.when(turn["truncated"], TRUNCATED).otherwise(0)
        lives = ~turn["dead"]
        deleted = lambda p: _after(p, DELETE, "D")
        kept = lambda p, initial: F.when(lives & (turn["initial"] == initial), _after(p, cut + KEEP, "K")).otherwise(never)
        reroled = lambda p, letter: F.when(lives, _after(p, cut + REROLE, letter)).otherwise(never)
        to_user = _let(F.least(none, system, assistant), lambda p: F.least(deleted(user), kept(p, "u"), reroled(p, "R")))
        stepped = four(deleted(none), F.least(deleted(system), kept(none, "s")), to_user, F.least(deleted(assistant), kept(user, "a"), reroled(user, "S")))
        return _let(stepped, _closed)

    start = four(_path(F.lit(0), F.lit("")), never, never, never)
    return F.aggregate(turns, _closed(start), step, lambda paths: F.least(paths["none"], paths["assistant"]))


def _applied(turns: Column, audit: Column) -> Column:
    """The repaired turns: each turn with the edits up to its own, then the inserts at the end."""
    pair = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    inserted = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: pair(F.when(x == "I", "user").otherwise("assistant"), F.lit("")))

    def one(turn: Column, edits: Column) -> Column:
        edit = F.right(edits, F.lit(1))
        role = F.when(edit == "R", "user").when(edit == "S", "assistant").otherwise(turn["role"])
        own = F.array(pair(role, turn["text"]))
        return F.concat(inserted(F.regexp_extract(edits, "^[IJ]*", 0)), F.filter(own, lambda x: edit != "D"))

    each = F.zip_with(turns, F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]"), F.lit(0)), one)
    return F.concat(F.flatten(each), inserted(F.regexp_extract(audit, r"[IJ]*\z", 0)))


def repair(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired, the turns (role, text) after the edits.

    gaps are turns missing between the least and the greatest; blank, duplicate and truncated count turns by their first fault, illegal the neighbouring roles that may not follow each other. copies: a column
    with how often each row stands; a conversation whose rows all stand 0 times has zeros and no turns."""
    turn = F.struct("turn", "role", "text", "initial", (F.col("blank") | F.col("duplicate")).alias("dead"), "truncated")
    count = lambda c: F.count_if(c).alias(c)
    each = _flagged(turns, copies).groupBy("conv_id").agg(*(count(c) for c in ("blank", "duplicate", "truncated", "illegal")), F.array_sort(F.collect_list(F.when(F.col("stands"), turn))).alias("turns"))
    each = each.withColumn("numbers", F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())))
    # the fold stands once in the plan: inline() keeps the projection below it from being merged into those above
    each = each.select("*", F.inline(F.array(_cheapest(F.col("turns")))))
    gaps = F.when(F.size("numbers") > 0, F.array_max("numbers") - F.array_min("numbers") + 1 - F.size("numbers")).otherwise(0)
    return each.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.translate("audit", "JS", "IR").alias("audit"), _applied(F.col("turns"), F.col("audit")).alias("repaired"))


def digest(repaired: Column) -> Column:
    """SHA-256 of repaired turns as role:text, joined by line feeds."""
    return F.sha2(F.concat_ws("\n", F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"]))).cast("binary"), 256)

"""Repair of conversation structure by an auction algorithm for shortest paths.

A conversation is to read as ``(s?(ua)+)?`` in its roles' initials: nothing, or an optional system turn and then pairs
of user and assistant. Each of its rows is kept, given another role or deleted, and turns without text are inserted;
blank and repeated rows have to be deleted. The points of the lattice are (rows so far, last initial); an edit is an arc
with a whole cost. A path grows from the start: its end either steps along its cheapest arc or, where no arc is as cheap
as the end's price allows, raises the price and steps back. When the path reaches the sink, prices are a dual solution:
arcs whose cost equals the fall in price are tight, and every cheapest repair runs over tight arcs only. Of those the
one whose letters (D, I, K, R) are least is traced.

Conversations of any length are cut into pieces of ``PIECE`` rows. Pieces of a conversation of several are solved each
on its own for each pair of end points, the pieces' costs form a coarse lattice with the same algorithm, whose prices
come back as the prices at the pieces' ends. Within a piece, blocks of ``BLOCK`` rows are solved from the last to
the first, so a price never rises far. What one task holds of a conversation is a row a piece and the audit itself.

Edge cases: a null role or text is one space (an unknown role, a blank text); null conv_ids are one conversation; rows
are taken by turn, nulls first, ties by role, then by the text's MD5; repeated rows stay rows, and the later ones are
duplicates; a conversation that has lost all its rows has zeros, an empty audit and the empty string's hash; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.llm import common, ranks
from bidloom.llm.sharding import crc32_sql, crc_table_sql

#: What a row's edits cost; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a piece (a power of two) and of a block.
PIECE_BITS, BLOCK = 12, 64
NEVER = 1 << 50

#: Points by the last initial: none yet, system, user, assistant. Initials: other, s, u, a.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, 1): SYSTEM, (START, 2): USER, (SYSTEM, 2): USER, (USER, 3): ASSISTANT, (ASSISTANT, 2): USER}
#: The turn that can follow where its role may be chosen.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A conversation may end where it has not begun, or with an assistant.
ENDS = [0, NEVER, NEVER, 0]

#: The arcs of a layer: for each point, (cost, 1 if the row is used up, next point, letter).
Layer = tuple[tuple[tuple[int, int, int, str], ...], ...]
INSERTS: Layer = tuple(((INSERT, 0, NEXT[q], "I"),) for q in range(4))


def layer(code: int) -> Layer:
    """The arcs of a row: code is its initial, plus 4 if truncated or 8 if it must go."""
    initial, fault = code & 3, code >> 2
    points = []
    for q in range(4):
        arcs = [(DELETE, 1, q, "D"), *INSERTS[q]]
        if fault < 2:
            if (q, initial) in KEPT:
                arcs.append((TRUNCATED * fault, 1, KEPT[q, initial], "K"))
            arcs.append((REROLE + TRUNCATED * fault, 1, NEXT[q], "R"))
        points.append(tuple(arcs))
    return tuple(points)


LAYERS = [layer(code) for code in range(12)]


class Block:
    """Layers with prices at their far end; ``prices`` are the dual solution for the points asked for."""

    def __init__(self, layers: list[Layer], ends: list[int], last: bool, asked: tuple[int, ...] = (0, 1, 2, 3)):
        self.sink = 4 * len(layers) + 4
        self.base = min(ends)
        self.arcs: list[list[tuple[int, int, str]]] = [[(c, 4 * (i + down) + t, x) for c, down, t, x in arcs] for i, points in enumerate(layers) for arcs in points]
        # What is inserted after a block's last row is inserted before the next one's first.
        self.arcs += [[(c, 4 * len(layers) + t, x) for c, _, t, x in INSERTS[q]] if last else [] for q in range(4)]
        for q, price in enumerate(ends):
            if price < NEVER:
                self.arcs[-4 + q].append((price - self.base, self.sink, ""))
        alive = self.leading(lambda node, arc: True)
        self.arcs = [[arc for arc in arcs if alive[arc[1]]] for arcs in self.arcs]
        # A point that no path leads on from is never entered; the others start at a price that no arc undercuts.
        self.prices = [0 if x else NEVER for x in alive]
        for q in asked:
            if alive[q]:
                self.auction(q)

    def leading(self, counts) -> list[bool]:
        """Which points lead to the sink over arcs that count."""
        found = [False] * self.sink + [True]
        for i in range(self.sink - 4, -1, -4):
            for q in (3, 2, 3, 1, 0):
                found[i + q] = any(found[arc[1]] and counts(i + q, arc) for arc in self.arcs[i + q])
        return found

    def auction(self, origin: int) -> None:
        """Raises prices until a path of tight arcs leads from the origin to the sink."""
        arcs, prices, path = self.arcs, self.prices, [origin]
        while (node := path[-1]) != self.sink:
            best, head = min([(cost + prices[to], to) for cost, to, _ in arcs[node]])
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)

    def entries(self) -> list[int]:
        return [self.prices[q] + self.base if self.prices[q] < NEVER else NEVER for q in range(4)]

    def trace(self, origin: int) -> tuple[int, str]:
        """The point at the far end, and the least letters, of a cheapest path from a point that was asked for."""
        prices = self.prices
        tight = lambda node, arc: prices[node] == arc[0] + prices[arc[1]]
        good = self.leading(tight)
        letters, node = [], origin
        while True:
            letter, head = min((x, to) for cost, to, x in self.arcs[node] if good[to] and tight(node, (cost, to)))
            if head == self.sink:
                return node % 4, "".join(letters)
            letters.append(letter)
            node = head


def solved(layers: list[Layer], ends: list[int], last: bool, asked: tuple[int, ...] = (0, 1, 2, 3)) -> list[Block]:
    """The blocks of a piece in order, each with exact prices at its entries."""
    found = []
    for i in range((len(layers) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        found.append(Block(layers[i : i + BLOCK], ends, last and not found, asked if i == 0 else (0, 1, 2, 3)))
        ends = found[-1].entries()
    return found[::-1]


def traced(blocks: list[Block], point: int) -> tuple[int, str]:
    letters = []
    for block in blocks:
        point, some = block.trace(point)
        letters.append(some)
    return point, "".join(letters)


def crossings(codes: list[int], last: bool) -> list[int]:
    """A piece's least costs from each point to each, row by row."""
    layers = [LAYERS[c] for c in codes]
    columns = [solved(layers, [0 if q == to else NEVER for q in range(4)], last)[0].entries() for to in range(4)]
    return [columns[to][q] for q in range(4) for to in range(4)]


def coarse(costs: list[list[int]]) -> list[list[int]]:
    """The prices at the end of each piece of a conversation, given the pieces' crossings."""
    layers = [tuple(tuple((c, 1, to, "") for to in range(4) if (c := some[4 * q + to]) < NEVER) for q in range(4)) for some in costs]
    bounds = [list(ENDS)]
    for i in range(len(layers) - 1, 0, -1):
        bounds.append(Block([layers[i]], bounds[-1], False).entries())
    return bounds[::-1]


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a schema written as "name type, ..."."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


def mapped(df: DataFrame, row, schema: str) -> DataFrame:
    """df with each row's dict put through row, which gives a list of tuples of schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(chain.from_iterable(map(row, batch.to_pylist())))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], types)

    types = arrow_schema(schema)
    names = types.names
    return df.mapInArrow(run, schema)


# What Spark does with it


def initial(role: Column) -> Column:
    """1, 2, 3 for roles that begin with s, u, a; 0 for others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, "sua")), F.substring(role, 1, 1)), F.lit(0)).cast("int")


def plain(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) without nulls in role and text."""
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults that a checksum of conversation and turn decides."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turns = plain(turns).withColumn("d", F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


#: The order of a conversation's rows.
def order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def judged(turns: DataFrame) -> DataFrame:
    """turns as rows (conv_id, turn, at, initial, fault) in order, without texts: fault is blank, duplicate, truncated or null."""
    text = F.col("text")
    blank, ended = ~text.rlike(r"[^\x20\x09-\x0D]"), text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    light = plain(turns).select("conv_id", "turn", "role", F.md5("text").alias("digest"), F.when(blank, "blank").when(~ended, "truncated").alias("own"))
    rows = ranks.in_order(light, F.col("conv_id").asc_nulls_first(), *order())
    # A text is said first where its first row is; rows of texts that are said once need no look.
    key = ["conv_id", "role", "digest"]
    firsts = rows.groupBy(*key).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(*(F.col(c).alias(f"_{c}") for c in key), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    rows = rows.join(firsts, same, "left")
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("own"))
    return rows.select("conv_id", "turn", "at", initial(F.col("role")).alias("initial"), fault.alias("fault"))


def in_pieces(rows: DataFrame) -> DataFrame:
    """Judged rows as pieces (conv_id, piece, n, codes, first, last, illegal): runs of a conversation's rows."""
    code = F.col("initial") + F.when(F.col("fault").isin("blank", "duplicate"), 8).when(F.col("fault") == "truncated", 4).otherwise(0)
    pieces = rows.groupBy("conv_id", F.shiftright("at", PIECE_BITS).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("at", code.alias("code")))).alias("rows"))
    pieces = pieces.select("conv_id", "piece", F.col("rows.code").alias("codes"))
    pair = lambda c, i: F.coalesce(F.get("codes", i - 1) % 4 * 4 + c % 4, F.lit(6))
    illegal = F.size(F.filter(F.transform("codes", pair), lambda p: ~p.isin(6, 11, 14)))
    return pieces.withColumns({"first": F.get("codes", F.lit(0)) % 4, "last": F.element_at("codes", -1) % 4, "illegal": illegal.cast("long")})


def audited(pieces: DataFrame) -> DataFrame:
    """Pieces as rows (conv_id, cost, audit), one a conversation: the cheapest edits and what they cost."""
    whole = pieces.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("piece").alias("head"), F.max("piece").alias("tail"))
    joined = pieces.join(whole.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    joined = common.stored(joined.select("conv_id", "piece", "codes", "n", (F.col("piece") == F.col("tail")).alias("last")), "pieces")

    def alone(r: dict) -> list[tuple]:
        blocks = solved([LAYERS[c] for c in r["codes"]], ENDS, True, (START,))
        return [(r["conv_id"], blocks[0].entries()[START], traced(blocks, START)[1])]

    kind = pieces.schema["conv_id"].dataType.simpleString()
    short = mapped(joined.where("n = 1").select("conv_id", "codes"), alone, f"conv_id {kind}, cost long, audit string")
    return short.unionByName(of_several(joined.where("n > 1"), kind))


def of_several(pieces: DataFrame, kind: str) -> DataFrame:
    """The same for conversations of several pieces: their crossings, the prices at their ends, the way through, its letters."""
    if pieces.isEmpty():
        return pieces.select("conv_id", F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    crossed = mapped(pieces.select("conv_id", "piece", "codes", "last"), lambda r: [(r["conv_id"], r["piece"], crossings(r["codes"], r["last"]))], f"conv_id {kind}, piece long, costs array<long>")

    def bounds(r: dict) -> list[tuple]:
        ends = coarse([x["costs"] for x in r["all"]])
        start = min((c + p for c, p in zip(r["all"][0]["costs"][:4], ends[0])), default=0)
        return [(r["conv_id"], x["piece"], end, start) for x, end in zip(r["all"], ends)]

    gathered = crossed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "costs"))).alias("all"))
    ends = mapped(gathered, bounds, f"c {kind}, p long, ends array<long>, cost long")
    priced = pieces.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))).drop("c", "p")

    def ways(r: dict) -> list[tuple]:
        blocks = solved([LAYERS[c] for c in r["codes"]], r["ends"], r["last"])
        return [(r["conv_id"], r["piece"], r["cost"], q, *traced(blocks, q)) for q in range(4) if blocks[0].entries()[q] < NEVER]

    found = common.stored(mapped(priced.select("conv_id", "piece", "codes", "last", "ends", "cost"), ways, f"conv_id {kind}, piece long, cost long, q int, to int, letters string"), "ways")

    def through(r: dict) -> list[tuple]:
        steps, out, q = {}, [], START
        for x in r["all"]:
            steps.setdefault(x["piece"], {})[x["q"]] = x["to"]
        for piece in sorted(steps):
            out.append((r["conv_id"], piece, q))
            q = steps[piece][q]
        return out

    way = mapped(found.groupBy("conv_id").agg(F.collect_list(F.struct("piece", "q", "to")).alias("all")), through, f"c {kind}, p long, s int")
    taken = found.join(way, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")) & (F.col("q") == F.col("s")))
    letters = F.array_join(F.sort_array(F.collect_list(F.struct("piece", "letters")))["letters"], "")
    return taken.groupBy("conv_id").agg(F.first("cost").alias("cost"), letters.alias("audit"))


def report(turns: DataFrame, everyone: DataFrame) -> DataFrame:
    """A row for each conversation of everyone (conv_id): gaps, faults by kind, illegal neighbours, and the cheapest repair."""
    rows = common.stored(judged(turns), "judged")
    pieces = common.stored(in_pieces(rows), "codes")
    zero = lambda *names: {n: F.lit(0).cast("long") for n in names}
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    faults = rows.groupBy("conv_id").agg(*(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")))
    span = rows.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id")
    span = span.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    # Between pieces: one row a piece.
    edges = F.sort_array(F.collect_list(F.struct("piece", "first", "last")))
    between = lambda e: F.size(F.filter(F.transform(e, lambda x, i: F.coalesce(F.get(e, i - 1)["last"] * 4 + x["first"], F.lit(6))), lambda p: ~p.isin(6, 11, 14)))
    illegal = pieces.groupBy("conv_id").agg(F.sum("illegal").alias("within"), edges.alias("e")).select("conv_id", (F.col("within") + between(F.col("e"))).alias("illegal"))
    parts = [everyone.select("conv_id"), faults, span, illegal, audited(pieces)]
    every = None
    for part in parts:
        part = part.withColumns(zero(*(n for n in names if n not in part.columns)))
        part = part.withColumn("audit", F.lit("")) if "audit" not in part.columns else part
        every = part if every is None else every.unionByName(part)
    return every.groupBy("conv_id").agg(*(F.max(n).alias(n) for n in names), F.max("audit").alias("audit"))


def edits(rows: Iterator[dict]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str, int | None]]]]:
    """Conversations of rows that come in order, each headed by its report: (report, its repaired turns)."""
    row = next(rows, None)
    while row is not None:
        head, letters, point = row, iter(row["audit"]), START

        def turns() -> Iterator[tuple[str, str, str, int | None]]:
            nonlocal row, point
            row = next(rows, None)
            for letter in letters:
                if letter != "I":
                    if letter == "K":
                        point = KEPT[point, " sua".find(row["role"][:1])]
                        yield letter, row["role"], row["text"], row["turn"]
                    elif letter == "R":
                        point = NEXT[point]
                        yield letter, ROLES[point], row["text"], row["turn"]
                    row = next(rows, None)
                else:
                    point = NEXT[point]
                    yield letter, ROLES[point], "", None

        yield head, turns()


def with_reports(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """Reports and turns of each conversation together, the report first, in the order of the audit's letters."""
    rows = plain(turns).withColumn("digest", F.md5("text")).withColumn("body", F.lit(1))
    both = reports.withColumn("body", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "body", *order()).drop("digest")


def digests(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """reports with ``repaired_sha256``: the hash of the repaired ``role:text`` lines, read as a stream."""
    columns = reports.columns
    kind = reports.schema["conv_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in columns if c not in ("conv_id", "audit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for head, turns in edits(row for batch in batches for row in batch.to_pylist()):
            sha = hashlib.sha256()
            for i, (_, role, text, _) in enumerate(turns):
                sha.update((f"\n{role}:" if i else f"{role}:").encode())
                sha.update(text.encode())
            out.append({c: head[c] for c in columns} | {"repaired_sha256": sha.hexdigest()})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, types)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, types)

    schema = f"conv_id {kind}, {longs}, audit string, repaired_sha256 string"
    types = arrow_schema(schema)
    return with_reports(turns, reports).mapInArrow(run, schema)


def repaired(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) repaired: rows (conv_id, place, turn, role, text, edit); inserted turns have no turn."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    number = turns.schema["turn"].dataType.simpleString()
    reports = report(turns, turns.select("conv_id").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, found in edits(row for batch in batches for row in batch.to_pylist()):
            rows = enumerate(found)
            while some := [(head["conv_id"], i, turn, role, text, edit) for (i, (edit, role, text, turn)), _ in zip(rows, range(1000))]:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in some], types)

    schema = f"conv_id {kind}, place long, turn {number}, role string, text string, edit string"
    types = arrow_schema(schema)
    names = types.names
    return with_reports(turns, reports).mapInArrow(run, schema)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and the repaired text's hash."""
    turns = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hurt = damaged(turns)
    return digests(hurt, report(hurt, turns.select("conv_id").distinct()))


def _oracle() -> str:
    def state(of: str, cost: int | str, letter: str, said: str = "") -> str:
        text = f"{of}.t || {said}" if said else f"{of}.t"
        return f"{{'c': {of}.c + {cost}, 'a': {of}.a || '{letter}', 't': {text}}}"

    def best(*options: str) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda s: s IS NOT NULL))"

    def inserted(source: str) -> str:
        """The states of a layer after inserts: first users, then assistants."""
        said = {2: "chr(10) || 'user:'", 3: "chr(10) || 'assistant:'"}
        user = best("q2", *(f"CASE WHEN {q} IS NOT NULL THEN {state(q, INSERT, 'I', said[2])} END" for q in ("q0", "q1", "q3")))
        late = best("q3", f"CASE WHEN u IS NOT NULL THEN {state('u', INSERT, 'I', said[3])} END")
        return f"SELECT * EXCLUDE (q2, q3, u), u AS q2, {late} AS q3 FROM (SELECT *, {user} AS u FROM ({source}))"

    def arcs(to: int) -> str:
        options = [f"CASE WHEN q{to} IS NOT NULL THEN {state(f'q{to}', DELETE, 'D')} END"]
        extra = f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
        stays = "coalesce(fault, '') NOT IN ('blank', 'duplicate')"
        for (q, kind), then in KEPT.items():
            if then == to:
                options.append(f"CASE WHEN q{q} IS NOT NULL AND initial = {kind} AND {stays} THEN {state(f'q{q}', f'({extra})', 'K', '''chr(10) || role || ':' || text''')} END")
        for q in range(4):
            if NEXT[q] == to:
                options.append(f"CASE WHEN q{q} IS NOT NULL AND {stays} THEN {state(f'q{q}', f'(1 + {extra})', 'R', f'''chr(10) || '{ROLES[to]}:' || text''')} END")
        return best(*options)

    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    step = inserted("SELECT p.k, p.i, p.q0, p.q1, p.q2, p.q3, f.initial, f.fault, f.role, f.text FROM p JOIN f ON f.k = p.k AND f.i = p.i + 1")
    return f"""
WITH RECURSIVE crc AS ({crc_table_sql()}),
x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
d AS (SELECT *, {crc32_sql("h")} % 20 AS d FROM x, crc),
e AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM d WHERE d <> 0 UNION ALL SELECT * FROM d WHERE d = 3)),
o AS (SELECT *, coalesce(conv_id::VARCHAR, 'none') AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM e),
f AS (
  SELECT *, coalesce(list_position(['s', 'u', 'a'], substr(role, 1, 1)), 0) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY k ORDER BY i) || substr(role, 1, 1) AS pair
  FROM o),
p AS (
  SELECT DISTINCT k, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS q0, {none} AS q1, {none} AS q2, {none} AS q3 FROM f
  UNION ALL
  SELECT k, i + 1, {arcs(0)}, {arcs(1)}, {arcs(2)}, {arcs(3)} FROM ({step})),
z AS (SELECT * FROM p QUALIFY i = max(i) OVER (PARTITION BY k)),
b AS (SELECT k, {best("q0", "q3")} AS q FROM ({inserted("SELECT * FROM z")})),
g AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(q.c, 0) AS cost, coalesce(q.a, '') AS audit, sha256(substr(coalesce(q.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS k FROM conversations) LEFT JOIN g USING (k) LEFT JOIN b USING (k)
"""


ORACLE = _oracle()

"""Tool-call linking: calls and results joined by identifier, put in topological order, checked against schemas, as canonical JSON.

* Linking. A call is (conv_id, call_id); of several the first by (turn, seq) counts, and so for results. Both are reduced
  by aggregation and joined by hash on both keys, so one long conversation or one much-used identifier is no hot key.
* Order. A call comes after the calls its arguments name (strings ``"$<call_id>"``). Where these stand earlier, as they mostly do,
  (turn, seq) is a topological order already; a call that names a later one takes over its place, one step behind, and so
  on along chains. Of conversations in which some call names a later one the needs alone, ``EDGES`` at most, go to one task, whatever the length of their
  chains; longer ones take joins over the affected calls until nothing moves. Calls on, or behind, a cycle keep their own place. Positions are counted in ranges of turns.
* Arguments are checked against the tool's JSON schema (type, required, properties, additionalProperties, items, enum, minimum, maximum,
  minLength, maxLength, pattern).
* JSON has sorted keys, no spaces, and no escapes but those that JSON requires.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomctx.llm.stage import release, small_batches, written

#: Turns whose calls are numbered by one task.
RANGE = 256
#: Needs of a conversation that one task puts in order; conversations with more take joins.
EDGES = 200_000
REFERENCE = r'"\$([^"\\]+)"'
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a JSON value, in order of its keys; empty if nothing."""
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if _is(value, "number"):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: no match")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += violations(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def _no_constant(name: str):
    raise ValueError(name)


def _serialise(schemas: dict[str, dict]):
    def one(name, call_id, arguments, result) -> tuple[str | None, str]:
        try:
            value = json.loads(arguments if arguments is not None else "", parse_constant=_no_constant)
        except (ValueError, RecursionError):
            return None, "$: not JSON"
        wrong = violations(value, schemas[name]) if name in schemas else ["$: unknown tool"]
        return canonical({"arguments": value, "id": call_id, "name": name, "result": result}), "; ".join(wrong)

    def kernel(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("name", "call_id", "arguments", "result")]
            out = [one(*r) for r in zip(*cols)]
            kept = [c for c in batch.schema.names if c not in ("arguments", "result")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], names=[*kept, "json", "errors"])

    return kernel


def places(own: dict, needs: dict) -> dict:
    """What moves of one conversation: call -> (turn, seq, behind), or None on or behind a cycle.

    own: call -> (turn, seq); needs: call -> the calls that it names. A call stands behind the latest call that it rests on, by the longest way there. Groups of
    calls that rest on each other are found first (Tarjan's search, without recursion), which gives the calls in an order of needs first, too. A
    call for which the latest call that a circle makes endlessly far is the latest of all lies on, or behind, a cycle.
    """
    number, low, on, stack, at = {}, {}, set(), [], 0
    best, endless = {}, {}
    for root in own:
        if root in number:
            continue
        walk = [(root, iter(needs.get(root, ())))]
        number[root] = low[root] = at = at + 1
        stack.append(root)
        on.add(root)
        while walk:
            call, rest = walk[-1]
            for need in rest:
                if need not in number:
                    number[need] = low[need] = at = at + 1
                    stack.append(need)
                    on.add(need)
                    walk.append((need, iter(needs.get(need, ()))))
                    break
                if need in on:
                    low[call] = min(low[call], number[need])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[call])
                if low[call] == number[call]:
                    group = set()
                    while call not in group:
                        group.add(stack.pop())
                    on -= group
                    outside = [n for c in group for n in needs.get(c, ()) if n not in group]
                    ends = [endless[n] for n in outside if endless[n] is not None]
                    if len(group) > 1 or call in needs.get(call, ()):
                        ends += [best[n][:2] for n in outside] + [own[c] for c in group]
                    far = max(ends, default=None)
                    for c in group:
                        endless[c] = far
                        best[c] = max([(*own[c], 0), *((*best[n][:2], best[n][2] + 1) for n in needs.get(c, ()) if n not in group)])
    found = {c: None if endless[c] is not None and endless[c] >= best[c][:2] else best[c] for c in own}
    return {c: p for c, p in found.items() if p is None or p[2]}


def _places(table: pa.Table) -> pa.Table:
    """The edges of one conversation, at most ``EDGES``, to the calls that move."""
    own, needs = {}, {}
    conv, call, turn, seq, need, need_turn, need_seq = (table[c].to_pylist() for c in ("conv_id", "call_id", "turn", "seq", "need", "need_turn", "need_seq"))
    for c, t, s, n, nt, ns in zip(call, turn, seq, need, need_turn, need_seq):
        own[c], own[n] = (t, s), (nt, ns)
        needs.setdefault(c, []).append(n)
    rows = [(conv[0], c, *(p or (*own[c], 0)), p is None) for c, p in places(own, needs).items()]
    return pa.Table.from_pylist([dict(zip(_MOVED.names, r)) for r in rows], schema=_MOVED)


_MOVED = pa.schema([("conv_id", pa.int64()), ("call_id", pa.string()), ("turn", pa.int64()), ("seq", pa.int64()), ("behind", pa.int64()), ("cyclic", pa.bool_())])


def _by_rounds(edges: DataFrame) -> DataFrame:
    """The same for conversations of any length: a step of all chains in each round, until nothing moves."""
    own = lambda t, s: F.struct(F.col(t).alias("turn"), F.col(s).alias("seq"), F.lit(0).cast("long").alias("behind"))
    keys = edges.select("conv_id", "call_id", own("turn", "seq").alias("place"))
    keys = keys.unionByName(edges.select("conv_id", F.col("need").alias("call_id"), own("need_turn", "need_seq").alias("place"))).distinct()
    behind = F.struct("other.turn", "other.seq", (F.col("other.behind") + 1).alias("behind"))
    late = edges.select("conv_id", "call_id", own("turn", "seq").alias("place"), own("need_turn", "need_seq").alias("other")).where("other >= place")
    front = all_moved = written(late.groupBy("conv_id", "call_id").agg(F.max("other").alias("other")).select("conv_id", "call_id", behind.alias("place")), "moved")
    rounds, most = 0, 0
    while not front.isEmpty() and rounds <= 2 * most + 2:
        # calls that need one which has moved, and would not come after it any more
        needed = front.select("conv_id", F.col("call_id").alias("need"), F.col("place").alias("other"))
        users = edges.select("conv_id", "call_id", "need").join(needed, ["conv_id", "need"]).groupBy("conv_id", "call_id").agg(F.max("other").alias("other"))
        now = users.join(keys, ["conv_id", "call_id"]).join(all_moved.withColumnRenamed("place", "better"), ["conv_id", "call_id"], "left").withColumn("place", F.coalesce("better", "place"))
        step = written(now.where("other >= place").select("conv_id", "call_id", behind.alias("place")), "moved")
        joined = written(all_moved.unionByName(step).groupBy("conv_id", "call_id").agg(F.max("place").alias("place")), "moved")
        release(*{id(x): x for x in (front, all_moved)}.values())
        front, all_moved = step, joined
        rounds, most = rounds + 1, all_moved.groupBy("conv_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    # no chain is longer than the calls that moved in its conversation; what is further behind goes round in a circle
    return all_moved.select("conv_id", "call_id", "place.turn", "place.seq", "place.behind", (F.col("place.behind") > most).alias("cyclic"))


def _ordered(calls: DataFrame, most: int = EDGES) -> DataFrame:
    """calls with ``place`` (turn, seq, steps behind) and ``cyclic``."""
    keys = calls.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"))
    edges = calls.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"), F.explode(F.array_distinct("needs")).alias("need"))
    edges = written(edges.join(keys.select("conv_id", F.col("call_id").alias("need"), F.col("turn").alias("need_turn"), F.col("seq").alias("need_seq")), ["conv_id", "need"]), "needs")
    # where no call names a later one all stand right
    late = F.struct("need_turn", "need_seq") >= F.struct(F.col("turn").alias("need_turn"), F.col("seq").alias("need_seq"))
    sizes = written(edges.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_or(late).alias("late")).where("late").drop("late"), "late")
    moved = None
    if not sizes.isEmpty():
        some = edges.join(sizes.where(F.col("n") <= most), "conv_id", "left_semi")
        moved = some.groupBy("conv_id").applyInArrow(_places, "conv_id long, call_id string, turn long, seq long, behind long, cyclic boolean")
        long = sizes.where(F.col("n") > most)
        if not long.isEmpty():
            moved = moved.unionByName(_by_rounds(edges.join(long, "conv_id", "left_semi")))
        moved = written(moved, "moved")
    own = F.struct(F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"), F.lit(0).cast("long").alias("behind"))
    if moved is None:
        return calls.withColumn("cyclic", F.lit(False)).withColumn("place", own)
    better = moved.select("conv_id", "call_id", F.struct("turn", "seq", "behind").alias("better"), F.col("cyclic").alias("round"))
    out = calls.join(better, ["conv_id", "call_id"], "left").withColumn("cyclic", F.coalesce("round", F.lit(False)))
    return out.withColumn("place", F.when(F.col("cyclic"), own).otherwise(F.coalesce("better", own))).drop("better", "round")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, position, name, status, errors, n_calls, n_results, json), a row for each call and each result without a call.

    calls: conv_id, turn, seq, call_id, name, arguments (JSON text). results: conv_id, turn, call_id, content. Other columns are not
    read. ``position`` counts a conversation's calls from 1. ``status``: ``ok``; ``invalid`` (schema, JSON or unknown tool);
    ``unanswered``; ``unresolved`` (names a call that isn't there); ``cyclic``; ``orphan`` (a result whose call isn't there, without position).
    The first that applies of cyclic, invalid, unresolved, unanswered counts. Rows with a null conv_id, call_id or turn can't be linked:
    calls and results are left out by contract of their sources' keys, and counted by nobody. Empty tables give an empty result.
    """
    small_batches(calls.sparkSession)
    calls = calls.where("conv_id is not null and call_id is not null and turn is not null")
    results = results.where("conv_id is not null and call_id is not null and turn is not null")
    first = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", F.coalesce("seq", F.lit(0)).alias("seq"), "name", "arguments")).alias("c"), F.count("*").alias("n_calls"))
    first = first.select("conv_id", "call_id", "c.*", "n_calls").withColumn("needs", F.coalesce(F.expr(f"regexp_extract_all(arguments, '{REFERENCE.replace(chr(92), chr(92) * 2)}', 1)"), F.array().cast("array<string>")))
    first = written(first, "calls")
    placed = _ordered(first.drop("arguments"))
    # positions: calls of earlier ranges of turns, then the place within the range
    part = F.floor(F.col("place.turn") / RANGE)
    placed = written(placed.withColumn("part", part), "placed")
    before = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("place", "turn", "seq", "call_id"))
    placed = placed.withColumn("k", within).join(before, ["conv_id", "part"]).withColumn("position", (F.col("before") + F.col("k")).cast("long"))
    there = first.select("conv_id", F.col("call_id").alias("need"), F.lit(1).alias("there"))
    missing = first.select("conv_id", "call_id", F.explode("needs").alias("need")).join(there, ["conv_id", "need"], "left_anti").select("conv_id", "call_id").distinct().withColumn("unresolved", F.lit(True))
    answers = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results")).select("conv_id", "call_id", F.col("r.content").alias("result"), "n_results")
    linked = first.select("conv_id", "call_id", "name", "arguments", "n_calls").join(placed.select("conv_id", "call_id", "position", "cyclic"), ["conv_id", "call_id"]).join(missing, ["conv_id", "call_id"], "left").join(answers, ["conv_id", "call_id"], "left")
    linked = linked.select("conv_id", "call_id", "position", "name", "cyclic", F.coalesce("unresolved", F.lit(False)).alias("unresolved"), "n_calls", F.coalesce("n_results", F.lit(0)).alias("n_results"), "arguments", "result")
    out = linked.mapInArrow(_serialise(schemas), "conv_id long, call_id string, position long, name string, cyclic boolean, unresolved boolean, n_calls long, n_results long, json string, errors string")
    status = F.when(F.col("cyclic"), "cyclic").when(F.col("errors") != "", "invalid").when(F.col("unresolved"), "unresolved").when(F.col("n_results") == 0, "unanswered").otherwise("ok")
    out = out.withColumn("status", status)
    orphans = answers.join(first.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    orphans = orphans.select("conv_id", "call_id", F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("name"), F.lit("orphan").alias("status"), F.lit("").alias("errors"), F.lit(0).cast("long").alias("n_calls"), "n_results", F.lit(None).cast("string").alias("json"))
    columns = ["conv_id", "call_id", "position", "name", "status", "errors", "n_calls", "n_results", "json"]
    return out.select(columns).unionByName(orphans.select(columns))

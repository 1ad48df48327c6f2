"""Schemas that drift between files (problem 3).

Lines are parsed by the built-in variant functions; the few they cannot tell go to Python.  Field sets and
value types are aggregated to one row per file, files of a feed follow each other by export time, and
each takes the row of the one before it along.  Only where fields both vanish and appear are the values
of these fields compared, in the messages that both files carry.  The few numbers this leaves per pair of
files go into similarity flooding, which settles the correspondences.  Groups handed to Python are bounded
by the number of fields of two files, not by their lines.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from turnwise.session import ensure_checkpoint_dir

#: Names known for the fixed columns of the unified table, in order; renames found in the feeds add to them.
UNIFIED_FIELDS = {
    "message_id": ["id"],
    "sent_at": ["timestamp", "time", "created_at", "datetime", "sent_at", "ts"],
    "speaker": ["speaker", "role", "author", "participant", "from", "sender"],
    "content": ["content", "message", "text", "value", "body", "msg"],
}

_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)[T ](\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:Z|\+00:?00)?")
_RECORD = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("name", "kind", "text")] + [T.StructField("nested", T.ArrayType(T.StringType()))])
)


def json_kind(value) -> str | None:
    """The JSON type of a parsed value; null has none."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def _leaves(value) -> Iterator:
    if isinstance(value, dict):
        for v in value.values():
            yield from _leaves(v)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v)
    elif value is not None:
        yield value


def canonical(value) -> str | None:
    """A spelling of a value that survives a change of its type or wrapping; null for null.

    Booleans read as numbers, UTC instants as seconds, wrapped texts as their leaves, lists and
    separated lists alike.
    """
    if value is None:
        return None
    out = []
    for leaf in _leaves(value):
        if isinstance(leaf, bool):
            out.append("1.0" if leaf else "0.0")
            continue
        text = str(leaf).strip().lower()
        if text in ("true", "false"):
            out.append("1.0" if text == "true" else "0.0")
            continue
        if m := _ISO.fullmatch(text.upper()):
            y, mo, d, h, mi, s = map(int, m.groups())
            ym, mm = y - (mo <= 2), mo + (9 if mo <= 2 else -3)
            text = str((365 * ym + ym // 4 - ym // 100 + ym // 400 + (153 * mm + 2) // 5 + d - 719469) * 86400 + h * 3600 + mi * 60 + s)
        try:
            number = float(text)
            if math.isfinite(number):
                while abs(number) >= 1e11:  # milli- and microseconds
                    number /= 1000
                out.append(repr(number))
                continue
        except ValueError:
            pass
        out.append(" ".join(re.findall(r"\w+", text)))
    return " ".join(x for x in out if x)


def _parse(raw: str | None):
    try:
        record = json.loads(raw)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    return record


def _text(value) -> str | None:
    """A value as the variant functions write it: texts bare, all else as JSON."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(_RECORD)
def parse_slowly(raw: pd.Series) -> pd.Series:
    """The fields of each line by Python, null for a line that is unreadable or no object (or not asked for)."""
    out = []
    for text in raw:
        record = _parse(text) if text is not None else None
        fields = None
        if record is not None:
            fields = [{"name": k, "kind": json_kind(v), "text": _text(v), "nested": sorted(v) if isinstance(v, dict) else None} for k, v in record.items()]
        out.append(fields)
    return pd.Series(out, dtype=object)


def with_fields(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``fields``: name, JSON type, text and nested keys of each field; null for a line that is no readable object.

    The line is parsed inside brackets, so that nothing may follow its object.  A line that the variant
    functions refuse (unreadable, or with repeated keys, or numbers beyond JSON), or in which an array of
    objects could hide a bracket too many, is read by Python instead; both ways give the same fields.
    Take the fields by ``explode_outer``: a test of them for null would be pushed down as a second parse.
    """
    x = lines.withColumn("_v", F.expr(f"try_parse_json(concat('[', {raw}, ']'))"))
    x = x.withColumns({"_o": F.expr("try_variant_get(_v, '$[0]', 'map<string,variant>')"), "_more": F.expr("try_variant_get(_v, '$[1]', 'variant')")})
    sure = F.col("_o").isNotNull() & F.col("_more").isNull() & ~F.col(raw).rlike(r"\}\s*\]")
    x = x.withColumn("_fast", sure)
    kind = """CASE WHEN t = 'VOID' THEN NULL WHEN t = 'STRING' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t LIKE 'ARRAY<%' THEN 'array'
        WHEN t LIKE 'OBJECT<%' THEN 'object' ELSE 'number' END"""
    field = f"""transform(array(schema_of_variant(e.value)), t -> named_struct('name', e.key, 'kind', {kind}, 'text', CAST(e.value AS STRING),
        'nested', if(t LIKE 'OBJECT<%', array_sort(json_object_keys(CAST(e.value AS STRING))), NULL)))[0]"""
    fast = F.expr(f"transform(map_entries(_o), e -> {field})")
    x = x.withColumn("_slow", parse_slowly(F.when(~F.col("_fast"), F.col(raw))))
    return x.withColumn("fields", F.when(F.col("_fast"), fast).otherwise(F.col("_slow"))).drop("_v", "_o", "_more", "_fast", "_slow")


def file_schemas(lines: DataFrame) -> DataFrame:
    """(file_id, fields): the fields of each file in name order, with their JSON types and nested keys."""
    x = with_fields(lines.select("file_id", "raw").where("file_id IS NOT NULL AND raw IS NOT NULL"))
    x = x.select("file_id", F.explode_outer("fields").alias("f")).where("f IS NOT NULL")
    x = x.select("file_id", "f.name", "f.kind", "f.nested").distinct()  # first within each task: a file's lines share few forms
    seen = x.groupBy("file_id").agg(F.collect_list(F.struct("name", "kind", "nested")).alias("s"))
    fields = """transform(array_sort(array_distinct(s.name)), n -> named_struct('field', n,
        'kinds', array_sort(array_distinct(filter(transform(filter(s, x -> x.name = n), x -> x.kind), k -> k IS NOT NULL))),
        'nested', array_sort(array_distinct(flatten(filter(transform(filter(s, x -> x.name = n), x -> x.nested), k -> k IS NOT NULL))))))"""
    return seen.select("file_id", F.expr(fields).alias("fields"))


def _placed(files: DataFrame, span_days: int) -> DataFrame:
    """(file_id, exported_at, feed_id, span): each file once, with its feed's time span."""
    f = files.select("file_id", "feed_id", "exported_at").where("file_id IS NOT NULL AND feed_id IS NOT NULL AND exported_at IS NOT NULL")
    f = f.groupBy("file_id").agg(F.min(F.struct("exported_at", "feed_id")).alias("m")).select("file_id", "m.*")
    return f.withColumn("span", F.expr(f"unix_date(to_date(exported_at)) div {span_days}"))


def with_predecessor(placed: DataFrame, *carried: str) -> DataFrame:
    """Adds ``prev``, a struct of file_id and the carried columns of the file before each in its feed, null for the first.

    A feed may hold a third of all files, so no window runs over a whole feed: files are ordered within a
    feed's time spans, and only one row per span is ordered over the feed.
    """
    me = F.struct("file_id", *carried)
    inner = Window.partitionBy("feed_id", "span").orderBy("exported_at", "file_id")
    within = placed.withColumn("_in", F.lag(me).over(inner))
    last = placed.groupBy("feed_id", "span").agg(F.max_by(me, F.struct("exported_at", "file_id")).alias("m"))
    outer = Window.partitionBy("feed_id").orderBy("span")
    before = last.select("feed_id", "span", F.lag("m").over(outer).alias("_before"))
    return within.join(before, ["feed_id", "span"], "left").withColumn("prev", F.coalesce("_in", "_before")).drop("_in", "_before")


def predecessors(files: DataFrame, span_days: int = 30) -> DataFrame:
    """(feed_id, file_id, prev_id): each file with the one before it in its feed by exported_at (then file_id).

    Files without feed or export time have no place in the order and no predecessor.
    """
    return with_predecessor(_placed(files, span_days)).select("feed_id", "file_id", F.col("prev.file_id").alias("prev_id"))


def _name_similarity(a: str, b: str) -> float:
    """Overlap of character trigrams of the names, ignoring case and separators."""
    x, y = (re.sub(r"[^a-z0-9]", "", n.lower()) for n in (a, b))
    if x == y:
        return 1.0
    grams = [{f" {n} "[i : i + 3] for i in range(len(n))} for n in (x, y)]
    return len(grams[0] & grams[1]) / max(1, len(grams[0] | grams[1]))


#: The share of a score that flows on: equal types alone must not outweigh what messages carry.
FLOW = 0.25


def flood(old: list[dict], new: list[dict], evidence: dict[tuple[str, str], tuple[int, int]], rounds: int = 50, epsilon: float = 1e-4) -> dict[tuple[str, str], float]:
    """Similarity flooding between two small schema graphs.

    Nodes are fields, their JSON types and nested keys; edges are labelled ``type`` and ``key``.  A
    pair's start value is the agreement of the carried values, which counts for less the fewer
    messages bear it out (9 of 10 is more than 1 of 1), plus a little for the name.  Scores
    flow (by a share of FLOW) along equally labelled edges of both graphs until they settle, the start value being added
    in each round, and are divided by the largest.
    """
    start: dict[tuple[str, str], float] = {}
    for o in old:
        for n in new:
            equal, both = evidence.get((o["field"], n["field"]), (0, 0))
            start["f:" + o["field"], "f:" + n["field"]] = (0.9 * equal / (both + 1) if both else 0.05) + 0.1 * _name_similarity(o["field"], n["field"])
    links: dict[tuple[str, str], list[tuple[str, str]]] = {p: [] for p in start}
    for o in old:
        for n in new:
            me = ("f:" + o["field"], "f:" + n["field"])
            for label in ("kinds", "nested"):
                for a in o[label]:
                    for b in n[label]:
                        other = (f"{label}:{a}", f"{label}:{b}")
                        start.setdefault(other, 1.0 if a == b else 0.1)
                        links[me].append(other)
                        links.setdefault(other, []).append(me)
    score = dict(start)
    for _ in range(rounds):
        nxt = {p: start[p] + score[p] for p in start}
        for p, neighbours in links.items():
            for q in neighbours:
                nxt[q] += FLOW * score[p] / len(neighbours)
        top = max(nxt.values())
        nxt = {p: v / top for p, v in nxt.items()}
        moved = max(abs(nxt[p] - score[p]) for p in nxt)
        score = nxt
        if moved < epsilon:
            break
    return {(a[2:], b[2:]): s for (a, b), s in score.items() if a.startswith("f:")}


def correspondences(old: list[dict], new: list[dict], evidence: dict[tuple[str, str], tuple[int, int]], least: float = 0.6) -> list[tuple[str, str]]:
    """Consistent one-to-one renames: best flooded score first, and the messages of both files must bear it out.

    At least one message must carry an equal value, and of those with a value on both sides a share
    of ``least`` must.
    """
    scores = flood(old, new, evidence) if old and new else {}
    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    out, used = [], set()
    for (a, b), _ in ranked:
        equal, both = evidence.get((a, b), (0, 0))
        if equal and equal >= least * both and ("o", a) not in used and ("n", b) not in used:
            used |= {("o", a), ("n", b)}
            out.append((a, b))
    return out


_MATCHED = "file_id long, change_kind string, old_field string, new_field string"


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, old, new, evidence in zip(pdf["file_id"], pdf["vanished"], pdf["appeared"], pdf["evidence"]):
            sides = [[{"field": x["field"], "kinds": list(x["kinds"]), "nested": list(x["nested"])} for x in (side if side is not None else [])] for side in (old, new)]
            told = {(e["old_field"], e["new_field"]): (int(e["equal"]), int(e["both"])) for e in (evidence if evidence is not None else [])}
            pairs = correspondences(sides[0], sides[1], told)
            rows += [(file_id, "renamed", a, b) for a, b in pairs]
            rows += [(file_id, "removed", x["field"], "") for x in sides[0] if x["field"] not in {a for a, _ in pairs}]
            rows += [(file_id, "added", "", x["field"]) for x in sides[1] if x["field"] not in {b for _, b in pairs}]
        yield pd.DataFrame(rows, columns=["file_id", "change_kind", "old_field", "new_field"])


@F.pandas_udf(T.StringType())
def canonical_text(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    """``canonical`` of values given by JSON type and text."""
    values = (json.loads(t) if k in ("array", "object") else t for k, t in zip(kinds, texts))
    return pd.Series([canonical(v) for v in values], dtype=object)


def _evidence(lines: DataFrame, changed: DataFrame) -> DataFrame:
    """(file_id, evidence) of files with vanished and appeared fields: for each pair of these the messages in both files
    that hold a value on both sides, and how many of them an equal one.

    Lines meet what is asked of their file (as the later or as the earlier one) once, and only fields asked
    for are compared.
    """
    asked = changed.where("size(vanished) > 0 AND size(appeared) > 0")
    sides = F.array(
        F.struct(F.col("prev_id").alias("of"), F.lit("o").alias("side"), F.col("vanished.field").alias("names")),
        F.struct(F.col("file_id").alias("of"), F.lit("n").alias("side"), F.col("appeared.field").alias("names")),
    )
    asked = asked.select(F.col("file_id").alias("pair"), F.explode(sides).alias("a"))
    asked = asked.groupBy(F.col("a.of").alias("file_id")).agg(F.collect_list(F.struct("pair", "a.side", "a.names")).alias("asks"))
    x = with_fields(lines.select("file_id", "raw").where("raw IS NOT NULL").join(asked, "file_id"))
    x = x.select("fields", F.expr("filter(fields, f -> f.name = 'id' AND f.text IS NOT NULL)[0].text").alias("id"), F.explode("asks").alias("a"))
    told = F.expr("if(id IS NULL, NULL, filter(fields, f -> f.text IS NOT NULL AND array_contains(a.names, f.name)))")
    x = x.select("a.pair", "id", "a.side", F.explode_outer(told).alias("f")).where("f IS NOT NULL")
    x = x.select("pair", "id", "side", F.col("f.name").alias("name"), F.xxhash64(canonical_text("f.kind", "f.text")).alias("h"))
    both = x.groupBy("pair", "id").agg(F.collect_set(F.struct("side", "name", "h")).alias("v"))
    names = lambda side: f"array_distinct(transform(filter(v, x -> x.side = '{side}'), x -> x.name))"
    values = lambda side, n: f"transform(filter(v, x -> x.side = '{side}' AND x.name = {n}), x -> x.h)"
    cells = f"""flatten(transform({names("o")}, o -> transform({names("n")}, n ->
        named_struct('old_field', o, 'new_field', n, 'same', arrays_overlap({values("o", "o")}, {values("n", "n")})))))"""
    cells = both.select("pair", F.explode(F.expr(cells)).alias("c"))
    counts = cells.groupBy("pair", "c.old_field", "c.new_field").agg(F.count_if("c.same").alias("equal"), F.count("*").alias("both"))
    told = F.collect_list(F.struct("old_field", "new_field", "equal", "both")).alias("evidence")
    return counts.groupBy(F.col("pair").alias("file_id")).agg(told)


def find_changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_id, change_kind, old_field, new_field) of every change from a file to the next one of its feed.

    Defined results: unreadable lines and lines that are no JSON object are left out; repeated lines
    and files count once; a file without readable lines has no fields, so its successor adds all of
    its fields and it removes all of its predecessor's; the first file of a feed reports nothing;
    a field that is null throughout has no type and is never retyped.
    One row per changed file is written to the checkpoint folder on the way.
    """
    ensure_checkpoint_dir(lines.sparkSession)
    placed = _placed(files, 30).join(file_schemas(lines), "file_id", "left").withColumn("fields", F.coalesce("fields", F.expr("array()")))
    x = with_predecessor(placed, "fields").where("prev IS NOT NULL").select("file_id", F.col("prev.file_id").alias("prev_id"), F.col("prev.fields").alias("was"), F.col("fields").alias("now"))
    clash = "y.field = x.field AND size(y.kinds) > 0 AND size(x.kinds) > 0 AND y.kinds <> x.kinds"
    x = x.select(
        "file_id", "prev_id", F.expr("filter(was, x -> NOT array_contains(now.field, x.field))").alias("vanished"),
        F.expr("filter(now, x -> NOT array_contains(was.field, x.field))").alias("appeared"),
        F.expr(f"transform(filter(was, x -> exists(now, y -> {clash})), x -> x.field)").alias("retyped"),
    )
    changed = x.where("size(vanished) + size(appeared) + size(retyped) > 0").checkpoint()
    kind = F.lit("retyped").alias("change_kind")
    retyped = changed.select("file_id", kind, F.explode("retyped").alias("old_field")).withColumn("new_field", F.col("old_field"))
    settled = changed.where("size(vanished) + size(appeared) > 0").join(_evidence(lines, changed), "file_id", "left")
    settled = settled.select("file_id", "vanished", "appeared", "evidence").mapInPandas(_settle, _MATCHED)
    return settled.unionByName(retyped)


# --- one table ------------------------------------------------------------------------------------

_CORE = {n: (target, i) for target, names in UNIFIED_FIELDS.items() for i, n in enumerate(names)}
#: Keys that hold the value itself where a value is wrapped in an object.
_MAIN_KEYS = ("text", "value", "content", "name", "id")
_KIND_BITS = {None: 0, "string": 1, "number": 2, "boolean": 4, "array": 8, "object": 16}
_ORIGINS = "array<struct<name:string,origin:string>>"


def renamed_on(origins: dict[str, str | None], moves: list[tuple[str, str]]) -> dict[str, str | None]:
    """The name that each present name goes back to, after one file's renames; None: the name was given up."""
    was = {old: (origins.get(old, old) or old) for old, _ in moves}
    return origins | {old: None for old, _ in moves} | {new: was[old] for old, new in moves}


def chained(before: dict[str, str | None], block: dict[str, str | None]) -> dict[str, str | None]:
    """``block``, which starts from the names at its border, applied to what went before the border."""
    return before | {name: origin and (before.get(origin, origin) or origin) for name, origin in block.items()}


def _pairs(origins: dict[str, str | None]) -> list[dict]:
    return [{"name": n, "origin": o} for n, o in sorted(origins.items())]


def _read_pairs(pairs) -> dict[str, str | None]:
    return {x["name"]: x["origin"] for x in pairs} if pairs is not None else {}


def _moves(pairs) -> list[tuple[str, str]]:
    return [(x["old_field"], x["new_field"]) for x in pairs] if pairs is not None else []


def field_origins(files: DataFrame, renames: DataFrame, span_days: int = 30) -> DataFrame:
    """(file_id, origins): for the renamed fields of each file the name they had first in their feed.

    The chain is sequential along a feed; as in ``predecessors`` it runs within time spans, whose
    compositions (one row per span) are then chained over the feed.
    """
    moves = renames.groupBy("file_id").agg(F.collect_list(F.struct("old_field", "new_field")).alias("moves"))
    f = _placed(files, span_days).join(moves, "file_id", "left").select("feed_id", "span", "exported_at", "file_id", "moves")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        origins: dict = {}
        for moves in pdf.sort_values(["exported_at", "file_id"])["moves"]:
            origins = renamed_on(origins, _moves(moves))
        return pd.DataFrame({"feed_id": pdf["feed_id"].iloc[:1].tolist(), "span": pdf["span"].iloc[:1].tolist(), "origins": [_pairs(origins)]})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        origins, rows = {}, []
        for feed_id, span, block in pdf.sort_values("span")[["feed_id", "span", "origins"]].itertuples(index=False):
            rows.append((feed_id, span, _pairs(origins)))
            origins = chained(origins, _read_pairs(block))
        return pd.DataFrame(rows, columns=["feed_id", "span", "entry"])

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        origins, rows = _read_pairs(pdf["entry"].iloc[0]), []
        for file_id, moves in pdf.sort_values(["exported_at", "file_id"])[["file_id", "moves"]].itertuples(index=False):
            origins = renamed_on(origins, _moves(moves))
            rows.append((file_id, _pairs({n: o for n, o in origins.items() if o is not None and o != n})))
        return pd.DataFrame(rows, columns=["file_id", "origins"])

    blocks = f.groupBy("feed_id", "span").applyInPandas(compose, f"feed_id long, span long, origins {_ORIGINS}")
    entries = blocks.groupBy("feed_id").applyInPandas(carry, f"feed_id long, span long, entry {_ORIGINS}")
    return f.join(entries, ["feed_id", "span"]).groupBy("feed_id", "span").applyInPandas(replay, f"file_id long, origins {_ORIGINS}")


def cast_leaf(leaf, kind: str) -> str | None:
    """The text of a scalar as boolean, bigint or double; None if it is none."""
    text = str(leaf).strip().lower()
    if kind == "boolean":
        return {"true": "true", "false": "false", "1": "true", "0": "false", "1.0": "true", "0.0": "false"}.get(text)
    if isinstance(leaf, bool):
        return None
    if re.fullmatch(r"[+-]?[0-9]{1,18}(?:\.0+)?", text):
        whole = int(text.partition(".")[0])
        return str(whole) if kind == "bigint" or abs(whole) <= 2**53 else None
    if kind == "bigint" or not re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?", text):
        return None
    number = float(text)
    return repr(number) if math.isfinite(number) and not re.fullmatch(r"[+-]?[0-9]+", text) else None


def unwrap(value) -> tuple[list, bool]:
    """The scalars that a wrapped value stands for, and whether they are all it holds."""
    if isinstance(value, dict):
        for k in _MAIN_KEYS:
            if value.get(k) is not None:
                leaves, whole = unwrap(value[k])
                return leaves, whole and len(value) == 1
        return list(_leaves(value)), not value
    if isinstance(value, list):
        parts = [unwrap(v) for v in value]
        return [x for leaves, _ in parts for x in leaves], all(whole for _, whole in parts)
    return ([] if value is None else [value]), True


def cast_value(value, kind: str, fixed: bool) -> tuple[str | None, bool]:
    """(text, whole): the value as ``kind``; whole if nothing of it is lost in that text.

    Texts of several scalars are joined by commas if they stood in a plain list, as separated lists
    are written, else (and in the fixed columns) by line breaks.
    """
    leaves, whole = unwrap(value)
    if kind != "string":
        return (cast_leaf(leaves[0], kind), whole) if len(leaves) == 1 else (None, False)
    plain = isinstance(value, list) and not any(isinstance(v, (dict, list)) for v in value)
    texts = [json.dumps(x) if isinstance(x, bool) and not fixed else str(x) for x in leaves]
    if plain and not fixed:
        return ",".join(texts), whole and not any("," in t for t in texts) and None not in value
    return "\n".join(texts), whole


_SEEN = "file_id long, field string, kinds int, n long, n_boolean long, n_bigint long, n_double long"


def _see(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen: dict = {}
        for file_id, text in zip(pdf["file_id"], pdf["raw"]):
            for name, value in (_parse(text) or {}).items():
                c = seen.setdefault((file_id, name), [0] * 5)
                c[0] |= _KIND_BITS[json_kind(value)]
                if value is not None:
                    c[1] += 1
                    for i, kind in enumerate(("boolean", "bigint", "double"), 2):
                        c[i] += cast_value(value, kind, False)[0] is not None
        yield pd.DataFrame([(*k, *c) for k, c in seen.items()], columns=["file_id", "field", "kinds", "n", "n_boolean", "n_bigint", "n_double"])


def families(renames: dict[tuple[str, str], int], files_with: dict[str, int], together: dict[tuple[str, str], int]) -> dict[str, str]:
    """One name for all names of a field over all feeds: name -> fixed column or the field's commonest name.

    Renames join names, best borne out first.  A rename that would join names which stand side by
    side in as many files as it was found in, or two fixed columns, joins nothing: such a name has
    another meaning elsewhere.
    """
    names = {n for pair in renames for n in pair} | set(files_with)
    group = {n: {n} for n in names}
    fixed = {target: {n for n in names if _CORE.get(n.lower(), ("",))[0] == target} for target in UNIFIED_FIELDS}
    for members in fixed.values():
        group |= {n: members for n in members}
    target_of = lambda g: next((t for t, m in fixed.items() if m is g), None)
    for (a, b), found in sorted(renames.items(), key=lambda x: (-x[1], x[0])):
        x, y = group[a], group[b]
        if x is y:
            continue
        if target_of(y):
            x, y = y, x
        if target_of(y) or any(together.get((min(p, q), max(p, q)), 0) >= found for p in x for q in y):
            continue
        x |= y
        group |= {n: x for n in y}
    return {n: target_of(g) or min(g, key=lambda m: (-files_with.get(m, 0), m)) for n, g in group.items()}


def unify_with(family: dict[str, str], kinds: dict[str, str]):
    """The function that reads a record into the fixed columns, the drifting fields by target, and the rest."""
    fixed = list(UNIFIED_FIELDS)

    @F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in (*fixed, "rest")] + [T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]))
    def unify_record(raw: pd.Series, origins: pd.Series) -> pd.DataFrame:
        out = []
        for text, pairs in zip(raw, origins):
            record = _parse(text)
            if record is None:
                out.append([None] * (len(fixed) + 2))
                continue
            known = _read_pairs(pairs)
            sources: dict[str, list] = {}
            for k in record:
                first = known.get(k, k)
                target = family.get(first) or _CORE.get(first.lower(), (None,))[0]
                if target in kinds or target in UNIFIED_FIELDS:
                    sources.setdefault(target, []).append((k not in known, _CORE.get(k.lower(), ("", 99))[1], len(sources), k))
            told, gone = {}, set()
            for target, names in sources.items():
                used = None
                for *_, k in sorted(names):
                    value = record[k]
                    if value is None:
                        gone.add(k)
                    elif used is None:
                        cast, whole = cast_value(value, kinds.get(target, "string"), target in UNIFIED_FIELDS)
                        if cast is not None:
                            told[target], used = cast, value
                            if whole:
                                gone.add(k)
                    elif value == used and type(value) is type(used):
                        gone.add(k)
            rest = json.dumps({k: v for k, v in record.items() if k not in gone}, ensure_ascii=False, sort_keys=True)
            out.append([*(told.get(t) for t in fixed), rest, {t: v for t, v in told.items() if t in kinds}])
        return pd.DataFrame(out, columns=[*fixed, "rest", "fields"])

    return unify_record


def _column_names(targets: list[str], taken: set[str]) -> dict[str, str]:
    """A column name for each target, distinct from all others disregarding case."""
    out: dict[str, str] = {}
    for t in targets:
        name = plain = re.sub(r"\W", "_", t) or "field"
        n = 1
        while name.lower() in taken:
            name, n = f"{plain}_{n + 1}", n + 1
        taken.add(name.lower())
        out[t] = name
    return out


def unified_records(files: DataFrame, lines: DataFrame, share: float = 0.95) -> DataFrame:
    """All readable records in one table: (file_id, feed_id, line_no, message_id, sent_at, speaker, content, rest) and
    one typed column for each other field that drifts.

    The renames found along each feed lead every name back to the first of its feed, and over all
    feeds to one name per field.  A field drifts if it is renamed or has several JSON types anywhere;
    its column is boolean, bigint or double if such values occur and ``share`` of all values can be
    read so, else string.  Values are coalesced, unwrapped and cast.  ``rest`` keeps as JSON, under
    the record's own names, the fields that never drift and every value that a column does not hold
    whole.  Repeated lines and files count once.
    Changes and field statistics are written once to the checkpoint folder; the driver gets one row
    per drifting name, pair of names renamed, or pair of such names that share a file.
    """
    ensure_checkpoint_dir(lines.sparkSession)
    once = lines.select("file_id", "line_no", "raw").where("raw IS NOT NULL").distinct()
    renames = find_changes(files, lines).where("change_kind = 'renamed'").select("file_id", "old_field", "new_field").checkpoint()
    seen = lines.where("raw IS NOT NULL").select("file_id", "raw").mapInPandas(_see, _SEEN)
    sums = [F.sum(c).alias(c) for c in ("n", "n_boolean", "n_bigint", "n_double")]
    seen = seen.groupBy("file_id", "field").agg(F.bit_or("kinds").alias("kinds"), *sums).checkpoint()

    edges = {(r.old_field, r.new_field): r["count"] for r in renames.groupBy("old_field", "new_field").count().collect()}
    named = renames.select(F.explode(F.array("old_field", "new_field")).alias("field")).distinct()
    core: Column = F.lower("field").isin(*_CORE)
    per_name = seen.groupBy("field").agg(F.count("*").alias("files"), F.bit_or("kinds").alias("kinds"), *sums)
    stats = {r.field: r for r in per_name.join(named.withColumn("renamed", F.lit(True)), "field", "left").where(core | F.col("renamed") | (F.bit_count("kinds") > 1)).collect()}
    in_file = seen.select("file_id", "field").join(named.unionByName(seen.select("field").where(core)).distinct(), "field")
    pairs = in_file.withColumnRenamed("field", "a").join(in_file.withColumnRenamed("field", "b"), "file_id").where("a < b")
    together = {(r.a, r.b): r["count"] for r in pairs.groupBy("a", "b").count().collect()} if edges else {}

    family = families(edges, {n: r.files for n, r in stats.items()}, together)
    kinds: dict[str, str] = {}
    for target in sorted(set(family.values()) - set(UNIFIED_FIELDS)):
        rows = [stats[n] for n, t in family.items() if t == target and n in stats]
        bits, n = 0, sum(r.n for r in rows)
        for r in rows:
            bits |= r.kinds
        can = lambda c: sum(r[c] for r in rows) >= share * n  # noqa: B023, E731
        whole = sum(r.n_bigint for r in rows) == sum(r.n_double for r in rows)
        kinds[target] = "boolean" if bits & 4 and can("n_boolean") else "bigint" if bits & 2 and whole and can("n_bigint") else "double" if bits & 2 and can("n_double") else "string"

    feeds = files.select("file_id", "feed_id").where("file_id IS NOT NULL").dropDuplicates(["file_id"])
    feeds = feeds.join(field_origins(files, renames), "file_id", "left")
    x = once.join(feeds, "file_id", "left").select("file_id", "feed_id", "line_no", unify_with(family, kinds)("raw", "origins").alias("u"))
    x = x.where("u.rest IS NOT NULL")
    columns = ["file_id", "feed_id", "line_no", *UNIFIED_FIELDS, "rest"]
    typed = [F.col("u.fields")[t].try_cast(kinds[t]).alias(name) for t, name in _column_names(list(kinds), set(columns)).items()]
    return x.select("file_id", "feed_id", "line_no", *(f"u.{c}" for c in (*UNIFIED_FIELDS, "rest")), *typed)

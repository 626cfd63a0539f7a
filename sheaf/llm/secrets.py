"""Secret scans with multipart credential linking; DataFrame functions only.

Three plain patterns (``assign``, ``access``, ``hex``) stand on their own.  Weak parts do not:
an account name, a secret-looking value or an endpoint is common in clean text.  The parts of
a document are put in order of place; a weak part is reported only where complementary parts
stand near it in the same scope (a paragraph): an identifier with a secret, or a secret with
an endpoint.  What overlaps a base match is that match, and a secret-looking piece of an
endpoint is a piece of the endpoint, so parts that overlap are no evidence for each other.
This is an interval join of the parts with themselves within scopes, done as one pass forwards
and one backwards over the ordered starts and stops of the parts, so no pairs are built.

Passes over arrays run in chunks, so their time grows with the number of matches, not with its
square.  Texts without any trigger skip all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6

# Weak parts.  A group is the part itself.
IDENTIFIER = r"""(?i)(?<![A-Za-z0-9_])(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
SECRET = r"""(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"""
ENDPOINT = r"""(?i)(?<![A-Za-z0-9_])(?:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+|(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{3,})"""

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "secret", "endpoint")
#: Characters between the end of one part and the start of another that still link.
REACH = 300

#: Orders in KINDS of the spans that redaction replaces.
REDACTED = (0, 1, 2, 4)

SPAN = "struct<start:int,order:int,stop:int>"
#: Items that one step of a pass over an array folds.
CHUNK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chunked(items: Column, body) -> Column:
    """``body(whole, number, chunk)`` of each run of at most CHUNK items; one empty run if there are none."""

    def runs(whole: Column) -> Column:
        last = F.greatest(F.floor((F.size(whole) - 1) / CHUNK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: body(whole, c, F.slice(whole, c * CHUNK + 1, CHUNK)))

    return _let(items, runs)


def _scan(items: Column, start: dict[str, Column], step, kind: str) -> Column:
    """What a pass over ``items`` emits, as one array of ``kind``.

    ``step(state, item)`` gives the new state, whether something is emitted, and what.  Chunks
    are folded one by one and their outputs kept apart until the end, for appending to an
    array copies it.
    """
    none, nones = (F.expr(f"cast(array() as array<{x}>)") for x in (kind, f"array<{kind}>"))

    def state(values: dict[str, Column], out: Column) -> Column:
        return F.struct(*(v.alias(k) for k, v in values.items()), out.alias("out"))

    def inner(s: Column, item: Column) -> Column:
        values, emits, what = step(s, item)
        return state(values, F.when(emits, F.concat(s["out"], F.array(what))).otherwise(s["out"]))

    def outer(s: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, state({k: s[k] for k in start}, none), inner)
        return _let(done, lambda d: state({k: d[k] for k in start}, F.concat(s["out"], F.array(d["out"]))))

    return F.aggregate(_chunked(items, lambda whole, number, chunk: chunk), state(start, nones), outer, lambda s: F.flatten(s["out"]))


def _span(start: Column, order: Column, stop: Column) -> Column:
    return F.struct(start.alias("start"), order.alias("order"), stop.alias("stop"))


def _spans(text: Column, pattern: str, order: int) -> Column:
    """Start, kind's order and stop of all matches, leftmost and non-overlapping.

    The text cut at the matches gives the gaps between them, and gaps and matches in turn give
    the places, in code points.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.char_length)

    def step(state: Column, pair: Column):
        begin = state["at"] + pair["gap"]
        end = begin + pair["size"]
        return {"at": end}, F.lit(True), _span(begin, F.lit(order), end)

    # the gap after the last match has no match
    pairs = F.filter(F.zip_with(gaps, found, lambda g, n: F.struct(g.alias("gap"), n.alias("size"))), lambda x: x["size"].isNotNull())
    return _scan(pairs, {"at": F.lit(0)}, step, SPAN)


def _none() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def base_spans(text: Column) -> Column:
    """The base matches as an array of (start, order, stop), sorted.

    ``assign`` matches with a short value are dropped after matching: what they cover stays
    covered.  A run of hex digits, or of the letters and digits after AKIA, is one match from
    its start to its end, so there a least length in the pattern drops the same matches.
    """
    low = F.lower(text)
    may_assign = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        may_assign = may_assign | low.contains(word)
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), F.char_length)
    assign = F.filter(F.zip_with(_spans(text, ASSIGN.replace("([A-Za", "(?:[A-Za"), 0), values, lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda x: x["n"] >= ASSIGN_LEAST)
    assign = F.when(may_assign, F.transform(assign, lambda x: x["s"])).otherwise(_none())
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(_none())
    return F.sort_array(F.concat(assign, access, hexes))


def _apart(parts: Column) -> Column:
    """The parts, sorted, without weak ones that overlap a base match and without secrets in endpoints."""

    def pass_over(items: Column, forward: bool, before: str) -> Column:
        far = F.lit(-1 if forward else 1 << 30)

        def step(state: Column, p: Column):
            def meets(edge: Column) -> Column:
                return edge > p["start"] if forward else edge < p["stop"]

            own = p["stop"] if forward else p["start"]
            reach = F.greatest if forward else F.least
            seen = {"base": F.when(p["order"] < 3, reach(state["base"], own)).otherwise(state["base"]), "place": F.when(p["order"] == 5, reach(state["place"], own)).otherwise(state["place"])}
            bad = (p["order"] >= 3) & meets(state["base"]) | (p["order"] == 4) & meets(state["place"])
            bad = bad | p["bad"] if before else bad
            return seen, F.lit(True), F.struct(p["start"].alias("start"), p["order"].alias("order"), p["stop"].alias("stop"), bad.alias("bad"))

        return _scan(items, {"base": far, "place": far}, step, "struct<start:int,order:int,stop:int,bad:boolean>")

    ahead = pass_over(F.sort_array(parts), True, "")
    judged = F.reverse(pass_over(F.reverse(ahead), False, "bad"))
    return F.transform(F.filter(judged, lambda p: ~p["bad"]), lambda p: _span(p["start"], p["order"], p["stop"]))


def weak_spans(text: Column, base: Column, reach: int = REACH) -> Column:
    """Weak parts that complementary parts in reach, within their scope, bear out.

    ``base`` takes part: an access key identifies, the others are secrets.
    """
    parts = _apart(F.concat(base, _spans(text, IDENTIFIER, 3), _spans(text, SECRET, 4), _spans(text, ENDPOINT, 5)))
    # scopes: their limits are blank lines, kept as parts of order 9
    parts = F.concat(parts, _spans(text, r"\n[\x20\t\r]*\n", 9))

    def event(p: Column, at: str, begins: bool) -> Column:
        return F.struct(p[at].alias("at"), F.lit(begins).alias("begins"), p["order"].alias("order"), p["start"].alias("start"), p["stop"].alias("stop"))

    # where a part stops and another starts, the stop comes first
    events = F.sort_array(F.flatten(F.transform(parts, lambda p: F.array(event(p, "stop", False), event(p, "start", True)))))

    def role(p: Column, *orders: int) -> Column:
        return p["order"].isin(*orders)

    def sweep(items: Column, forward: bool) -> Column:
        """Weak parts that a complementary part on the side already swept bears out.

        A part is seen once it is left behind as a whole and judged before it is entered, so
        parts that overlap never bear each other out.
        """
        far = F.lit(-(1 << 30) if forward else 1 << 30)

        def step(state: Column, p: Column):
            left = p["begins"] != F.lit(forward)

            def close(kind: str) -> Column:
                return (p["at"] - state[kind] if forward else state[kind] - p["at"]) <= reach

            seen = {x: F.when(role(p, 9), far).when(left & role(p, *orders), p["at"]).otherwise(state[x]) for x, orders in (("i", (1, 3)), ("s", (0, 2, 4)), ("e", (5,)))}
            linked = ~left & (role(p, 3, 5) & close("s") | role(p, 4) & (close("i") | close("e")))
            return seen, linked, _span(p["start"], p["order"], p["stop"])

        return _scan(items, dict.fromkeys(("i", "s", "e"), far), step, SPAN)

    both = _let(events, lambda e: F.concat(sweep(e, True), sweep(F.reverse(e), False)))
    return _let(F.sort_array(both), lambda found: F.filter(found, lambda p, i: (i == 0) | (F.get(found, i - 1) != p)))


def render(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"], s["stop"])), ",")


def find(docs: DataFrame, reach: int = REACH, base: str = "base", spans: str = "spans") -> DataFrame:
    """Add the columns ``base`` and ``spans`` to the documents: arrays of (start, order, stop), sorted.

    ``order`` counts in KINDS; ``spans`` holds base and linked spans.  Places are code points,
    the stop exclusive.  A null text has none.  Every row is judged by itself, so repeated
    rows, null ids and other columns make no difference (columns of the two names are
    replaced); an empty table gives no rows.  Time grows with a text's length and matches.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # weak parts only matter where a secret may stand: a base span, or a long mixed value
    may = (F.size(base) > 0) | text.rlike(r"[A-Za-z0-9+/_-]{20}")
    out = docs.withColumn(base, base_spans(text))
    linked = F.when(may, weak_spans(text, F.col(base), reach)).otherwise(_none())
    return out.withColumn(spans, F.sort_array(F.concat(F.col(base), linked)))


def redact(docs: DataFrame, mark: str = "[secret]", reach: int = REACH) -> DataFrame:
    """The documents, each found secret replaced by ``mark``; n_chars follows where it was right.

    Linked identifiers and endpoints bear a secret out but stay in the text.  A document
    without secrets is returned as it is, as are null texts, repeated rows and other columns;
    an empty table gives no rows.
    """
    found = find(docs, reach, "__base", "__spans").withColumn("__spans", F.filter("__spans", lambda s: s["order"].isin(*REDACTED)))

    def cut(state: Column, s: Column):
        begin = F.greatest(s["start"], state["at"])
        return {"at": F.greatest(state["at"], s["stop"])}, s["stop"] > state["at"], F.struct(begin.alias("start"), s["stop"].alias("stop"))

    def part(cuts: Column, number: Column, chunk: Column) -> Column:
        """The text from the chunk before to the end of this one, its cuts replaced by marks."""
        begin = F.when(number == 0, F.lit(0)).otherwise(F.get(cuts, number * CHUNK - 1)["stop"])
        end = F.get(chunk, F.size(chunk) - 1)["stop"]
        own = F.substring(F.col("text"), begin + 1, end - begin)

        def marked(own: Column) -> Column:
            before = lambda i: F.when(i == 0, begin).otherwise(F.get(chunk, i - 1)["stop"])
            return F.array_join(F.transform(chunk, lambda s, i: F.concat(F.substring(own, before(i) - begin + 1, s["start"] - before(i)), F.lit(mark))), "")

        return _let(own, marked)

    def whole(cuts: Column) -> Column:
        last = F.get(cuts, F.size(cuts) - 1)["stop"]
        return F.concat(F.array_join(_chunked(cuts, part), ""), F.substring(F.col("text"), last + 1, F.char_length("text")))

    done = _let(_scan(F.col("__spans"), {"at": F.lit(0)}, cut, "struct<start:int,stop:int>"), whole)
    # a column of its own first: inside lambdas a new column's name would hide the old one
    found = found.withColumn("__changed", F.when(F.size("__spans") > 0, done).otherwise(F.col("text")))
    right = (F.size("__spans") > 0) & (F.col("n_chars") == F.char_length("text")) if "n_chars" in docs.columns else None
    new = {"text": F.col("__changed")}
    if right is not None:
        new["n_chars"] = F.when(right, F.char_length("__changed")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def op4(spark, sf_dir: str) -> DataFrame:
    """Contract query: base and linked spans of every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["order"] == k)).cast("long").alias(f"n_{BASE[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(render(F.col("base")).cast("binary"), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))

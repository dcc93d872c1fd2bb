"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL expressions only.

Seeds are what fixed formats find: email, ip, card, phone, and `secret` (access keys of a public format, long
hexadecimal strings).  Candidates are identifier-like strings that no format accepts: digit groups with
separators (seven digits or more), addresses written with "at", and unbroken runs of letters and digits
(eight characters or more).  What stands around an instance gives its lexical patterns, from strict to loose:
    a  the two words before      b  the word before and the word after      c  the word before alone
    d  what is glued to its front, such as key=      e  an assignment (= or :) whose key is a free slot, and
       the instance's alphabet; only for runs of letters and digits
Over the graph of patterns and instances Spark scores in turns: a pattern by the share of one kind among its
known instances (each value once; candidates of no known kind are unlabelled), an instance by its best
pattern.  Candidates under a pattern that enough different known instances support, with a share of at least
SHARE, are added with the kind of their best pattern, as are the seeds of `secret`.

Positions come from splitting: a text's pieces between matches and the matches themselves give each start
(running sums in blocks of BLOCK matches).  Expressions that look at no digit, '+' or '@' are skipped.
Possessive forms keep matching linear in a text's length; they match what the plain forms match.  Context is
read from the whole text between a match and the one before; the text's start counts as a word ("^").

Defined results: null or empty text has no spans; null doc_id and repeated rows are carried (copies of one value
support a pattern once); an empty table gives no rows; very long texts are treated whole; further columns
are ignored, and kept by redact whatever their names.  Ties between patterns go to the greater kind's name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fresh, materialize, scratch

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Known instances that must support a pattern (one word alone needs more), the share that must be of its kind, turns.
SUPPORT, ALONE, SHARE, TURNS = 5, 10, 0.8, 3
#: Matches whose starts are summed together.
BLOCK = 256

#: The four formats (possessive; a run that failed from its start is not tried from within).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates: whole digit groups, addresses with "at" in brackets; and runs that mix letters and digits.
LOOSE = r"(?<![(0-9+A-Za-z.])\(?[0-9]++(?:[().\x20/-]++[0-9]++)*+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
TOKEN = r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[0-9A-Za-z_-]{8,}+"
#: Tokens that are known: access key ids (a fixed public prefix), hexadecimal strings of 128 bits or more.
SECRET = r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,}|[0-9A-F]{32,})$"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _valid(kind: str, x: str, after: str) -> str:
    """after: the text that follows."""
    if kind == "ip":
        return f"forall(split({x}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)"
    if kind == "card":
        d = _digits(x)
        luhn = f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + case when (length({d}) - i) % 2 = 1 then 2 * cast(substring({d}, i, 1) as int) - if(cast(substring({d}, i, 1) as int) > 4, 9, 0) else cast(substring({d}, i, 1) as int) end) % 10 = 0"
        return f"(case when length({d}) between 13 and 19 then {luhn} else false end)"
    if kind == "phone":
        return f"length({_digits(x)}) between 9 and 15"
    if kind == "loose":
        return f"(instr({x}, 'at') > 0 or (length({_digits(x)}) >= 7 and not {after} rlike '^[0-9A-Za-z]'))"
    return "true"


def _short(x: str) -> str:
    """A word as a context: itself, or its digest where it is very long."""
    return f"lower(if(length({x}) > 100, md5({x}), {x}))"


SPAN = "array<struct<s:int,e:int,v:string,g:string,w1:string,w2:string,r:string>>"


def _spans(pattern: str, kind: str, guard: str) -> str:
    """SPAN: start, end, value, what is glued to its front, the two words before, the word after."""
    r = _sql(pattern)
    tail = lambda k: f"reverse(regexp_extract(q.back, '^(\\\\S*+)\\\\s*+(\\\\S*+)\\\\s*+(\\\\S*+)', {k}))"
    sums = f"aggregate(slice(y.n, c * {BLOCK} + 1, {BLOCK}), 0, (i, x) -> i + x)"
    none = "cast(array() as array<int>)"
    bases = f"aggregate(sequence(0, (size(y.m) - 1) div {BLOCK}), named_struct('at', 0, 'got', {none}), (a, c) -> named_struct('at', a.at + {sums}, 'got', concat(a.got, array(a.at))), a -> a.got)"
    starts = f"flatten(transform({bases}, (b, c) -> aggregate(slice(y.n, c * {BLOCK} + 1, {BLOCK}), named_struct('at', b, 'got', {none}), (a, x) -> named_struct('at', a.at + x, 'got', concat(a.got, array(a.at))), a -> a.got)))"
    places = f"filter(transform({starts}, (at, i) -> named_struct('at', at, 'i', i)), q -> {_valid(kind, 'y.m[q.i]', 'y.p[q.i + 1]')})"
    context = f"transform({places}, q -> named_struct('i', q.i, 's', q.at + length(y.p[q.i]), 'v', y.m[q.i], 'back', reverse(y.p[q.i]), 'after', y.p[q.i + 1]))"
    start = "if(q.i = 0, '^', '')"
    one, two = f"if({tail(2)} = '', {start}, {tail(2)})", f"if({tail(2)} = '', '', if({tail(3)} = '', {start}, {tail(3)}))"
    right = "regexp_extract(q.after, '^\\\\s*+(\\\\S*+)', 1)"
    found = f"transform({context}, q -> named_struct('s', q.s, 'e', q.s + length(q.v), 'v', q.v, 'g', {_short(tail(1))}, 'w1', {_short(one)}, 'w2', {_short(two)}, 'r', {_short(right)}))"
    # arrays of one bind what is used more than once
    cut = f"transform(array(named_struct('p', split(t, {r}, -1), 'm', regexp_extract_all(t, {r}, 0))), z -> named_struct('p', z.p, 'm', z.m, 'n', zip_with(slice(z.p, 1, size(z.m)), z.m, (p, m) -> length(p) + length(m))))"
    return f"case when {guard} then flatten(transform({cut}, y -> case when size(y.m) > 0 then {found} else cast(array() as {SPAN}) end)) else cast(array() as {SPAN}) end"


GUARDS = {"email": "t rlike '[A-Za-z0-9-][@][A-Za-z0-9-]+[.]|[%+._][@][A-Za-z0-9-]+[.]'", "ip": "t rlike '[0-9][.][0-9]+[.][0-9]+[.][0-9]'", "card": "t rlike '[0-9](?:[\\\\x20-]?[0-9]){12}'", "phone": "instr(t, '+') > 0", "loose": "t rlike '[0-9][0-9().\\\\x20/-]{5}|[\\\\[(]at[\\\\])]'", "token": "t rlike '[A-Za-z_-][0-9]|[0-9][A-Za-z_-]'"}


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, one array of spans per kind (`secret` among them), and `loose`: candidates that no span overlaps."""
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    found = t.select("doc_id", *(F.expr(_spans(p, k, GUARDS[k])).alias(k) for k, p in zip((*KINDS, "loose", "token"), (EMAIL, IP, CARD, PHONE, LOOSE, TOKEN), strict=True)))
    found = found.select("doc_id", *KINDS, "loose", "token", F.expr(f"filter(token, x -> x.v rlike {_sql(SECRET)})").alias("secret"))
    free = " and ".join(f"not exists({k}, b -> b.s < c.e and c.s < b.e)" for k in ALL_KINDS)
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", *ALL_KINDS, F.expr(f"filter(concat(loose, filter(token, x -> not x.v rlike {_sql(SECRET)})), c -> {free})").alias("loose"))


#: The patterns of a span x.
ALPHABET = "case when x.v rlike '^[0-9a-f]+$' then 'hex' when x.v rlike '^[0-9A-Z]+$' then 'upper' when x.v rlike '^[0-9a-zA-Z_-]+$' and x.v rlike '[A-Za-z]' then 'mixed' end"
ASSIGNED = "regexp_extract(concat(x.w1, ' ', x.g), '([=:])\\\\x20?[\\\\x22\\']?$', 1)"
PATTERNS = f"""filter(array(
    if(x.w1 <> '' and x.w2 <> '', concat('a ', x.w2, ' ', x.w1, ' ', x.g), null),
    if(x.w1 <> '' and x.r <> '', concat('b ', x.w1, ' ', x.g, ' _ ', x.r), null),
    if(x.w1 <> '' and x.w1 <> '^', concat('c ', x.w1, ' ', x.g), null),
    if(x.g rlike '[a-z]', concat('d ', x.g), null),
    if({ASSIGNED} <> '', concat('e ', {ASSIGNED}, ' ', {ALPHABET}), null)), p -> p is not null)"""


def learn_patterns(base: DataFrame, support: int = SUPPORT, share: float = SHARE, turns: int = TURNS, alone: int = ALONE) -> DataFrame:
    """(c, kind, share): patterns whose instances are, by share and support, personal data of that kind."""
    seeds = base.select(F.explode(F.concat(*(F.expr(f"transform({k}, x -> named_struct('kind', '{k}', 'v', x.v, 'c', {PATTERNS}))") for k in ALL_KINDS))).alias("x")).select("x.kind", "x.v", F.explode("x.c").alias("c"))
    loose = base.select(F.explode(F.expr(f"transform(loose, x -> named_struct('kind', cast(null as string), 'v', x.v, 'c', {PATTERNS}))")).alias("x")).select("x.kind", "x.v", F.explode("x.c").alias("c"))
    norm = F.lower(F.regexp_replace("v", "[^0-9A-Za-z@.]", ""))
    # the graph, counted before any join: a value or context that is everywhere is one row
    graph = materialize(seeds.unionByName(loose).groupBy("c", norm.alias("inst"), "kind").agg(F.count("*").alias("n")), "pii-graph")
    seed = graph.where("kind is not null").groupBy("inst").agg(F.max(F.struct("n", "kind"))["kind"].alias("kind"), F.lit(1.0).alias("score"))
    known, pairs, patterns = seed, graph.select("c", "inst").distinct(), None
    enough = F.when(F.col("c").startswith("c "), alone).otherwise(support)
    for turn in range(turns):
        # each value once a context; values without a kind say nothing, those of another kind speak against it
        scored = pairs.join(known, "inst").groupBy("c", "kind").agg(F.sum("score").alias("w"), F.count("*").alias("n"), F.count(F.when(F.col("score") >= share, 1)).alias("support"))
        p = scored.groupBy("c").agg(F.max(F.struct("w", "kind", "support")).alias("best"), F.sum("n").alias("n")).select("c", "best.kind", "best.support", (F.col("best.w") / F.col("n")).alias("share"))
        patterns = materialize(p.where((F.col("support") >= enough) & (F.col("share") >= share)).select("c", "kind", "share"), "pii-patterns")
        if turn == turns - 1 or patterns.isEmpty():
            break
        found = graph.where("kind is null").select("c", "inst").join(patterns, "c").groupBy("inst").agg(F.max(F.struct("share", "kind")).alias("x")).select("inst", "x.kind", F.col("x.share").alias("score"))
        known = materialize(seed.unionByName(found.join(seed.select("inst"), "inst", "left_anti")), "pii-known")
    return patterns


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, spans per kind (arrays email...), and `added`: array of kind, s, e."""
    with scratch(docs.sparkSession) as keep:
        base = materialize(base_spans(docs, id_col, text_col), "pii-base")
        patterns = learn_patterns(base)
        keep += [base, patterns]
    loose = base.where("size(loose) > 0").select("row", F.explode("loose").alias("x")).select("row", "x.s", "x.e", F.explode(F.expr(PATTERNS)).alias("c"))
    best = loose.join(patterns, "c").groupBy("row", "s", "e").agg(F.max(F.struct("share", "kind"))["kind"].alias("kind"))
    more = best.groupBy("row").agg(F.collect_list(F.struct("kind", "s", "e")).alias("more"))
    added = F.expr("array_sort(concat(transform(secret, x -> named_struct('kind', 'secret', 's', x.s, 'e', x.e)), coalesce(more, cast(array() as array<struct<kind:string,s:int,e:int>>))))")
    return base.drop("loose").join(more, "row", "left").withColumn("added", added).drop("more", "secret")


def _joined(kinds: tuple[str, ...], with_added: bool) -> str:
    parts = []
    for k in kinds:
        own = f"transform({k}, x -> named_struct('s', x.s, 'e', x.e))" if k in KINDS else "cast(array() as array<struct<s:int,e:int>>)"
        more = f"transform(filter(added, x -> x.kind = '{k}'), x -> named_struct('s', x.s, 'e', x.e))"
        both = f"array_sort(concat({own}, {more}))" if with_added else own
        parts.append(f"transform({both}, x -> concat_ws(':', '{k}', cast(x.s as string), cast(x.e as string)))")
    return f"concat_ws(',', {', '.join(parts)})"


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span (base and added) of text_col replaced by its kind in brackets; other columns stay."""
    row, spans = fresh(docs, "pii_row"), fresh(docs, "pii_spans")
    marked = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "pii-docs")
    found = find_personal_data(marked, row, text_col)
    every = ", ".join([*(f"transform({k}, x -> named_struct('s', x.s, 'e', x.e, 'kind', '{k}'))" for k in KINDS), "transform(added, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind))"])
    # in order of start; a span that begins inside an earlier one only moves its end
    found = found.select(F.col("doc_id").alias(row), F.expr(f"array_sort(concat({every}))").alias(spans)).where(F.size(spans) > 0)
    t = f"`{text_col}`"
    out = f"aggregate({spans}, named_struct('at', 0, 'got', ''), (a, x) -> case when x.s >= a.at then named_struct('at', x.e, 'got', concat(a.got, substring({t}, a.at + 1, x.s - a.at), '[', x.kind, ']')) else named_struct('at', greatest(a.at, x.e), 'got', a.got) end, a -> concat(a.got, substring({t}, a.at + 1)))"
    return marked.join(found, row, "left").withColumn(text_col, F.expr(f"case when {spans} is null then {t} else {out} end")).drop(row, spans)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.expr(_joined(KINDS, False)), 256).alias("base_sha256"), F.expr(_joined(ALL_KINDS, True)).alias("spans"))

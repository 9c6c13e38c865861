r"""Personal data by patterns and information-theoretic sanitisation, in DataFrame and SQL functions only.

Patterns find the protected entities: emails, addresses, cards and phones. The
words of their documents are terms. A term t tells of an entity e by PMI(t, e)
= log(n(t, e) N / (n(t) n(e))), where the n count documents of the whole
corpus; the entity itself tells IC(e) = log(N / n(e)), the most that any term
can. A term that tells at least DISCLOSURE of IC(e), and whose co-occurrence
with e chance doesn't explain (log-likelihood ratio of SIGNIFICANT or more),
gives e away and is removed everywhere in e's documents. Entities are
generalised to their kind. On demand only words within context code points of
an entity are terms, and support different contexts take the place of the test.

The patterns are written so that a search takes linear time: a run of an
email's characters is tried once, at its start or where the last match ended
(\G), and all repetitions are possessive, which changes no match since what
follows them can't be matched by what they repeat. Only a byte's leading zeros
may be given back: the last one is the byte itself where it is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_of, staged

DISCLOSURE = 0.8
#: Least log-likelihood ratio of a term and an entity: one in a thousand by chance.
SIGNIFICANT = 10.83
WORD = r"\p{L}++"
#: Elements of an array that are appended one by one.
BLOCK = 256
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for any match that counts.
HINTS = {"email": "contains(t, '@')", "ip": r"t rlike r'[0-9]\.[0-9]'", "card": "t rlike r'[0-9](?:[ -]?[0-9]){11}'", "phone": "contains(t, '+')"}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMPTY = "cast(array() as array<struct<s:int,e:int,t:string>>)"
LUHN = "aggregate(sequence(1, length(x.d)), 0, (a, i) -> a + case when i % 2 = 1 then int(substring(x.d, length(x.d) - i + 1, 1)) when int(substring(x.d, length(x.d) - i + 1, 1)) > 4 then 2 * int(substring(x.d, length(x.d) - i + 1, 1)) - 9 else 2 * int(substring(x.d, length(x.d) - i + 1, 1)) end) % 10 = 0"
CHECKS = {
    "email": ("lower(x.t)", "true"),
    "ip": ("x.t", rf"x.t rlike r'^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$'"),
    "card": ("regexp_replace(x.t, '[ -]', '')", "length(x.d) between 12 and 19"),
    "phone": ("regexp_replace(x.t, '[^0-9]', '')", "length(x.d) between 9 and 15"),
}


def blocks(array: str) -> str:
    """SQL for an array in blocks of BLOCK elements. Building an array by appending takes time in the square of its length; within blocks, and over them, that is little for any text."""
    return f"transform(sequence(0, greatest(size({array}) - 1, 0) div {BLOCK}), b -> slice({array}, b * {BLOCK} + 1, {BLOCK}))"


def located(text: str, pattern: str) -> str:
    """SQL for the matches of a pattern, as structs of start, end (code points) and text: what lies between the matches gives their places."""
    both = f"zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (g, m) -> named_struct('g', length(g), 'm', m))"
    within = f"""aggregate(x, named_struct('p', at, 'o', {EMPTY}),
      (a, y) -> if(y.m is null, a, named_struct('p', a.p + y.g + length(y.m), 'o', concat(a.o, array(named_struct('s', a.p + y.g, 'e', a.p + y.g + length(y.m), 't', y.m))))), a -> a.o)"""
    begins = "aggregate(cut, named_struct('p', 0, 'o', cast(array() as array<int>)), (a, x) -> named_struct('p', a.p + aggregate(x, 0, (n, y) -> n + y.g + coalesce(length(y.m), 0)), 'o', concat(a.o, array(a.p))), a -> a.o)"
    # A value is named by making it the one element of an array.
    return f"flatten(element_at(transform(transform(array({both}), every -> {blocks('every')}), cut -> zip_with(cut, {begins}, (x, at) -> {within})), 1))"


def rewritten(text: str, spans: str, kinds: str) -> str:
    """SQL for a text whose spans, in order, are replaced by their kinds; what overlaps is replaced once, under the first one's kind.

    A piece is a kind with the text's part before it, from a to b. Pieces are
    made by block, each block's pieces cut out of the block's part of the text.
    """
    pieces = "cast(array() as array<struct<a:int,b:int,k:int>>)"
    step = f"aggregate(x, named_struct('p', c.p, 'o', {pieces}), (d, y) -> named_struct('p', greatest(d.p, y.e), 'o', if(y.s < d.p, d.o, concat(d.o, array(named_struct('a', d.p, 'b', y.s, 'k', y.k))))))"
    whole = f"aggregate({blocks(spans)}, named_struct('p', 0, 'o', cast(array() as array<array<struct<a:int,b:int,k:int>>>)), (c, x) -> element_at(transform(array({step}), n -> named_struct('p', n.p, 'o', concat(c.o, array(n.o)))), 1))"
    part = "substring(t, element_at(x, 1).a + 1, element_at(x, -1).b - element_at(x, 1).a)".replace("(t,", f"({text},")
    made = f"element_at(transform(array(named_struct('u', {part}, 'at', element_at(x, 1).a)), v -> array_join(transform(x, y -> concat(substring(v.u, y.a - v.at + 1, y.b - y.a), '[', upper(element_at({kinds}, y.k + 1)), ']')), '')), 1)"
    return f"element_at(transform(array({whole}), w -> concat(array_join(transform(filter(w.o, x -> size(x) > 0), x -> {made}), ''), substring({text}, w.p + 1, length({text})))), 1)"


def base_spans(kind: str) -> Column:
    """The spans of one kind in column t that pass its checks: kind, s, e and the entity's value."""
    value, check = CHECKS[kind]
    found = f"case when {HINTS[kind]} then {located('t', PATTERNS[kind])} else {EMPTY} end"
    valued = f"filter(transform({found}, x -> named_struct('s', x.s, 'e', x.e, 't', x.t, 'd', {value})), x -> {check})"
    if kind == "card":
        valued = f"filter({valued}, x -> {LUHN})"
    return F.expr(f"transform({valued}, x -> named_struct('s', x.s, 'k', {KINDS.index(kind)}, 'e', x.e, 'v', x.d))")


def _near(marked: DataFrame, context: int) -> DataFrame:
    """(id, th, entity, term, context) of the words within context code points of an entity; words that the edges cut are left out."""
    spans = marked.where(F.size("spans") > 0).select("id", "th", "t", F.explode("spans").alias("sp"))
    around = spans.select("id", "th", F.concat_ws(":", F.col("sp.k"), F.col("sp.v")).alias("entity"), F.col("sp.s").alias("s"), F.col("sp.e").alias("e"), F.expr(f"substring(t, greatest(sp.s - {context}, 0) + 1, least({context}, sp.s))").alias("left"), F.expr(f"substring(t, sp.e + 1, {context})").alias("right"), F.expr("length(t)").alias("n"))
    before = f"transform(filter({located('left', WORD)}, w -> w.s > 0 or s <= {context}), w -> lower(w.t))"
    after = f"transform(filter({located('right', WORD)}, w -> w.e < {context} or e + {context} >= n), w -> lower(w.t))"
    return around.select("id", "th", "entity", F.xxhash64("left", "right").alias("context"), F.expr(f"explode(array_distinct(concat({before}, {after})))").alias("term"))


def _ratio(both: Column, term: Column, entity: Column, whole: Column) -> Column:
    """The log-likelihood ratio of the fourfold table of two counts, their common count and the count of all."""
    cells = [(both, term * entity), (term - both, term * (whole - entity)), (entity - both, entity * (whole - term)), (whole - term - entity + both, (whole - term) * (whole - entity))]
    parts = [F.when((seen > 0) & (of > 0), seen * F.log(seen * whole / of)).otherwise(0.0) for seen, of in cells]
    return 2 * (parts[0] + parts[1] + parts[2] + parts[3])


def _disclosing(marked: DataFrame, total: int, context: int | None, support: int | None, disclosure: float) -> DataFrame:
    """Places (id, th, s, e) of the terms that give an entity of their document away."""
    some = staged(marked.where(F.size("spans") > 0), "some")
    whole = F.lit(float(total))
    entity = "array_distinct(transform(spans, x -> concat_ws(':', x.k, x.v)))"
    owned = staged(some.select("id", "th", F.expr(entity).alias("own")).dropDuplicates(["id", "th"]), "owned")
    entities = staged(owned.select(F.explode("own").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")), "entities")
    counted = marked.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(WORD), F.lit(0)))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    # No term of more documents can tell enough, even if it stands with the entity in all of the entity's.
    most = whole ** (1 - disclosure) * F.col("n_entity").cast("double") ** disclosure * (1 + 1e-9)
    top = entities.agg(F.max(most)).first()[0] or 0.0
    few = counted.where(F.col("n_term") <= top)
    if context is None:
        words = some.dropDuplicates(["id", "th"]).select("id", "th", F.expr(entity).alias("own"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(WORD), F.lit(0)))).alias("term"))
        pairs = words.join(few, "term").select("id", "th", "term", "n_term", F.explode("own").alias("entity"), F.lit(0).alias("context"))
    else:
        pairs = _near(marked, context).join(few, "term")
    pairs = staged(pairs.join(entities, "entity").where(F.col("n_term") <= most), "pairs")
    found = pairs.groupBy("entity", "term", "n_term", "n_entity").agg(F.count_distinct("context").alias("contexts"), F.count_distinct(F.struct("id", "th")).alias("both"))
    told = F.log(F.col("both") * whole / (F.col("n_term") * F.col("n_entity")))
    own = F.log(whole / F.col("n_entity"))
    enough = _ratio(*[F.col(c).cast("double") for c in ("both", "n_term", "n_entity")], whole) >= SIGNIFICANT if support is None else F.col("contexts") >= support
    found = found.where((own > 0) & (told >= disclosure * own) & enough)
    terms = pairs.join(found.select("entity", "term"), ["entity", "term"], "left_semi").groupBy(F.col("id").alias("gi"), F.col("th").alias("gt")).agg(F.collect_set("term").alias("gone"))
    texts = some.dropDuplicates(["id", "th"]).join(terms, F.col("id").eqNullSafe(F.col("gi")) & (F.col("th") == F.col("gt")))
    # What lies between the words gives their places; only lengths are shuffled.
    parts = texts.select("id", "th", "gone", F.posexplode(F.expr(f"zip_with(split(t, r'{WORD}', -1), regexp_extract_all(t, r'{WORD}', 0), (g, m) -> named_struct('g', length(g), 'm', m))")).alias("i", "x"))
    sizes = parts.select("id", "th", "i", F.col("x.g").alias("g"), F.coalesce(F.length("x.m"), F.lit(0)).alias("n"), F.expr("array_contains(gone, lower(x.m))").alias("hit"))
    placed = sizes.withColumn("e", F.sum(F.col("g") + F.col("n")).over(Window.partitionBy("id", "th").orderBy("i")).cast("int")).where("hit")
    return placed.select("id", "th", (F.col("e") - F.col("n")).alias("s"), "e")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out_col: str = "pii", keep: list[str] | None = None, context: int | None = None, support: int | None = None, disclosure: float = DISCLOSURE, rewrite: bool = True) -> DataFrame:
    """Adds out_col: spans (kind, start, end, in code points, by start and then kind), and text with every span replaced by its kind in brackets.

    A null text stays null and has no spans; rows of the same id and text
    share their spans; overlapping spans are replaced once, under the first
    one's kind; an empty table gives an empty result; other columns pass
    through. Terms inside an entity are not spans of their own. Without rewrite
    the text is left out.
    """
    keep = docs.columns if keep is None else keep
    if out_col in keep:
        raise ValueError(f"the input has a column {out_col} already; name another out_col")
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("t"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True) if c != text_col])
    spans = F.when(F.col("t").isNotNull(), F.concat(*[base_spans(k) for k in KINDS[:4]])).otherwise(F.expr("cast(array() as array<struct<s:int,k:int,e:int,v:string>>)"))
    marked = rows.withColumn("spans", spans)
    near = _disclosing(marked.select("id", "th", "t", "spans"), docs.count(), context, support, disclosure)
    more = near.groupBy(F.col("id").alias("mi"), F.col("th").alias("mt")).agg(F.collect_set(F.struct("s", F.lit(4).alias("k"), "e")).alias("more"))
    plain = marked.withColumn("spans", F.expr("transform(spans, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"))
    if not rewrite:
        plain = plain.drop("t")
    joined = plain.join(more, plain.id.eqNullSafe(more.mi) & (plain.th == more.mt), "left").withColumn("spans", F.expr("array_sort(concat(spans, filter(coalesce(more, cast(array() as array<struct<s:int,k:int,e:int>>)), x -> not exists(spans, y -> y.s < x.e and x.s < y.e))))")).drop("id", "mi", "mt", "more")
    kinds = f"array({', '.join(repr(k) for k in KINDS)})"
    made = [F.expr(f"transform(spans, x -> named_struct('kind', element_at({kinds}, x.k + 1), 'start', x.s, 'end', x.e))").alias("spans")]
    if rewrite:
        made.append(F.expr(f"case when size(spans) = 0 then t else {rewritten('t', 'spans', kinds)} end").alias("text"))
    return joined.select(*[F.col("t" if c == text_col else n).alias(c) for c, n in zip(keep, names, strict=True)], F.struct(*made).alias(out_col))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise(docs_of(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"], out_col="p", rewrite=False)
    joined = lambda spans: f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    base = "filter(p.spans, x -> x.kind <> 'term')"
    counts = [F.expr(f"cast(size(filter(p.spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.expr(f"sha2({joined(base)}, 256)").alias("base_sha256"), F.expr(joined("p.spans")).alias("spans"))

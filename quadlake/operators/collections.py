"""Lists: rebuilding rdf:first/rest chains, members, and construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake._io import materialise
from quadlake.model import COLUMNS, QUADS, RDF_FIRST, RDF_NIL, RDF_REST
from quadlake.operators import _chains


def _runs(q: DataFrame) -> DataFrame:
    """The links of list cells; one that does not lead to a node is marked bare."""
    rest = q.filter(F.col("p") == RDF_REST)
    return _chains.contracted(rest.select("graph_iri", F.col("s_id").alias("a"), F.when(F.col("o_id") != RDF_NIL, F.col("o_id")).alias("b"), F.col("o_id").isNull().alias("bare")))


def _chained(runs: DataFrame) -> tuple[DataFrame, bool]:
    """graph_iri, cell, head, pos, bare of lists that share no cells (bare is null in a last cell without a link); whether some have no
    end. head is null on those, and in a bare cell that no other leads to."""
    places, rings = _chains.places(runs)
    return places.select("graph_iri", F.col("a").alias("cell"), F.when(~(F.coalesce("bare", F.lit(False)) & (F.col("pos") == 0)), F.col("head")).alias("head"), "pos", "bare"), rings


def _jumped(q: DataFrame) -> DataFrame:
    """list_positions where lists share cells, by doubling jumps along rdf:rest: log2(length) rounds."""
    rest = q.filter((F.col("p") == RDF_REST) & F.col("o_id").isNotNull()).select("graph_iri", F.col("s_id").alias("cell"), F.col("o_id").alias("next"))
    rest = materialise(rest)
    heads = rest.join(rest.filter(F.col("next") != RDF_NIL).select("graph_iri", F.col("next").alias("cell")), ["graph_iri", "cell"], "left_anti")
    # left[k]: how many cells stand before; jump from each cell back to the head.
    back = rest.filter(F.col("next") != RDF_NIL).select("graph_iri", F.col("next").alias("cell"), F.col("cell").alias("at"), F.lit(1).alias("pos"))
    moved = materialise(back.unionByName(heads.select("graph_iri", "cell", F.col("cell").alias("at"), F.lit(0).alias("pos"))).withColumn("moved", F.lit(True)))
    rounds = moved.count().bit_length() + 1  # a list without an end would go on
    while rounds and not moved.filter("moved").isEmpty():
        state, rounds = moved.drop("moved"), rounds - 1
        nxt = state.select("graph_iri", F.col("cell").alias("at"), F.col("at").alias("further"), F.col("pos").alias("more"))
        moved = materialise(state.join(nxt, ["graph_iri", "at"], "left").select("graph_iri", "cell", F.coalesce("further", "at").alias("at"), (F.col("pos") + F.coalesce("more", F.lit(0))).alias("pos"), (F.coalesce("more", F.lit(0)) > 0).alias("moved")))
    return heads.select("graph_iri", F.col("cell").alias("head")).join(moved.select("graph_iri", F.col("at").alias("head"), "cell", "pos"), ["graph_iri", "head"])


def list_positions(q: DataFrame) -> DataFrame:
    """graph_iri, head, cell, pos of every list that ends."""
    runs = _runs(q)
    return _chained(runs)[0].filter("head IS NOT NULL").select("graph_iri", "head", "cell", "pos") if _chains.simple(runs) else _jumped(q)


def rebuild_lists(q: DataFrame) -> DataFrame:
    """q with list cells folded: a list of literals of one datatype becomes a literal_collection object, any other a
    term_collection of members in order; statements of cells other than rdf:first and rdf:rest stay, as do lists without an end."""
    runs = _runs(q)
    at, cell = ["graph_iri", "cell"], F.col("s_id").alias("cell")
    first = q.filter(F.col("p") == RDF_FIRST).withColumn("cell", F.col("s_id"))
    rest = q.filter(F.col("p") == RDF_REST).withColumn("cell", F.col("s_id"))
    if _chains.simple(runs):
        places, rings = _chained(runs)
        placed = materialise(first.join(places.withColumn("endless", F.col("head").isNull() & ~F.col("bare")), at, "left"))
        stay = placed.filter("bare IS NULL OR endless")
        placed = placed.filter("head IS NOT NULL")
        if rings:
            stay = stay.select(*COLUMNS).unionByName(rest.join(places.filter("head IS NULL AND NOT bare"), at, "left_semi").select(*COLUMNS))
    else:
        places = materialise(_jumped(q))
        placed = first.join(places, at)
        endless = rest.filter("o_id IS NOT NULL").select("graph_iri", cell).join(places, at, "left_anti")
        folded = rest.select("graph_iri", cell).join(endless, at, "left_anti")
        stay = first.unionByName(rest).join(folded, at, "left_anti")
    stay = stay.select(*COLUMNS).unionByName(q.filter(F.coalesce(~F.col("p").isin(RDF_FIRST, RDF_REST), F.lit(True))))
    item = F.struct(F.col("pos").cast("int").alias("pos"), F.col("o_kind").alias("kind"), F.col("o_id").alias("id"), F.col("o_lex").alias("lex"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))
    dt = F.when(F.col("o_kind") == "literal", F.col("o_dt"))
    lists = placed.groupBy("graph_iri", "head").agg(F.sort_array(F.collect_list(item)).alias("items"), F.min(dt).alias("least"), F.max(dt).alias("most"), F.count(F.when(F.col("o_kind") != "literal", 1)).alias("others"))
    lists = lists.select("graph_iri", F.col("head").alias("o_id"), F.col("items").cast(QUADS["o_items"].dataType).alias("items"), (F.coalesce(F.col("least") == F.col("most"), F.lit(False)) & (F.col("others") == 0)).alias("plain"))
    joined = stay.join(lists, ["graph_iri", "o_id"], "left")
    kind = F.when(F.col("o_id") == RDF_NIL, "term_collection").when(F.col("items").isNull(), F.col("o_kind")).when(F.col("plain"), "literal_collection").otherwise("term_collection")
    node = F.when(F.coalesce(F.col("plain"), F.lit(False)), F.lit(None).cast("string")).otherwise(F.col("o_id"))
    none = F.array().cast(QUADS["o_items"].dataType)
    items = F.coalesce("items", "o_items", F.when(F.col("o_id") == RDF_NIL, none))
    kept = ["graph_iri", "s_kind", "s_id", "p", "o_lex", "o_dt", "o_lang", "o_num"]
    return joined.select(*kept, kind.alias("o_kind"), node.alias("o_id"), items.alias("o_items")).select(*COLUMNS)


def members(q: DataFrame) -> DataFrame:
    """graph_iri, s_id, p, pos (from 0) and the member's kind, id, lex, dt, lang, in order of pos."""
    return q.filter("o_items IS NOT NULL").select("graph_iri", "s_id", "p", F.posexplode("o_items").alias("pos", "m")).select("graph_iri", "s_id", "p", "pos", "m.kind", "m.id", "m.lex", "m.dt", "m.lang")


def member(items, i: int):
    """The member at a place from 0; null beyond the end."""
    return F.get(items, F.lit(i))


def collect(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """One ordered list (column items) for each key."""
    return df.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, value))), lambda x: x[value]).alias("items"))


def set_members(q: DataFrame, s: str, p: str, items: DataFrame) -> DataFrame:
    """q in which the list of one statement has the members of items (pos, kind, id, lex, dt, lang)."""
    new = items.agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in ("pos", "kind", "id", "lex", "dt", "lang")]))).cast(QUADS["o_items"].dataType).alias("__new"))
    here = (F.col("s_id") == s) & (F.col("p") == p) & F.col("o_items").isNotNull()
    return q.crossJoin(new).withColumn("o_items", F.when(here, F.col("__new")).otherwise(F.col("o_items"))).select(*COLUMNS)  # new is one row

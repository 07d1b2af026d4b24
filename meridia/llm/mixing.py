"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  The tokens to keep of each cell are raked to the three target
marginals in turn, by window sums over the table of cells.  A cell can't give more than it has: after every
``SWEEPS`` sweeps, cells asked for more are kept whole from then on and the others are raked to what is left, until
nothing changes any more.  A document is kept when its uniform number, a hash of its id, is under its cell's
probability.  Marginals that the supply can't meet stay short; :meth:`Raking.report` tells them.  DataFrame functions only.

A document's topic is the one whose vocabulary it holds most words of, ties to the first listed, ``general`` without any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.llm.support import free_name, materialize, sized

DIMS = ("source", "lang", "topic")
SPACE = "[\\x20\\x09-\\x0D]+"
SWEEPS = 4  # between two looks at cells that are asked for too much
# Topic vocabularies, English, German, French, Spanish.
TOPICS = {
    "law": ("license", "licensed", "copyright", "rights", "law", "court", "contract", "warranty", "lizenz", "recht", "gesetz", "vertrag", "licence", "droit", "loi", "contrat", "licencia", "derecho", "ley", "contrato"),
    "technology": ("software", "code", "data", "server", "file", "function", "version", "key", "token", "daten", "datei", "funktion", "logiciel", "fichier", "fonction", "donnees", "datos", "archivo"),
    "commerce": ("price", "buy", "order", "shop", "sale", "free", "offer", "click", "casino", "bets", "preis", "kaufen", "angebot", "prix", "acheter", "offre", "precio", "comprar", "oferta"),
    "people": ("email", "phone", "address", "contact", "name", "call", "mail", "telefon", "adresse", "kontakt", "courriel", "correo", "contacto", "nombre"),
}


def with_topic(df: DataFrame, text: Column, out: str, words: str, topics: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``df`` with the topic of a text as ``out`` and its lower-case words as ``words``.  Each step is a column of its own, so
    that a text is split once."""
    topics, found, counts = topics or TOPICS, free_name(df, "found_words"), free_name(df, "topic_counts")
    every = sorted({w for lot in topics.values() for w in lot})
    df = df.withColumn(words, F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), ""))
    df = df.withColumn(found, F.array_intersect(words, F.array(*map(F.lit, every))))
    df = df.withColumn(counts, F.array(*[F.size(F.array_intersect(found, F.array(*map(F.lit, lot)))) for lot in topics.values()]))
    most = F.array_max(counts)
    name = reduce(lambda c, it: c.when(F.col(counts)[it[0]] == most, it[1]), enumerate(topics), F.when(most == 0, "general"))
    return df.withColumn(out, name.otherwise("general")).drop(found, counts)  # never null: a join would filter by it, spelt out


class Raking:
    """``temper``: a marginal's target share is its token share to this power, normalised; ``targets`` may give
    shares outright ({dim: {value: share}}; values not named share what is left, by tempered tokens).
    ``fraction``: tokens to keep, of all; ``rounds``: most rounds of ``SWEEPS`` sweeps; ``settled``: a round that moves
    no cell by more than this share of the tokens ends the raking.

    Null values of a dimension are one value of their own; null texts are empty.  Cells without a token are kept.  Rows
    that repeat an id share its uniform number; rows with a null id have their text's.
    """

    def __init__(self, temper=None, targets=None, fraction: float = 0.7, rounds: int = 60, settled: float = 1e-11):
        self.temper = {"source": 0.7, "lang": 0.7, "topic": 0.7} | (temper or {})
        self.targets, self.fraction, self.rounds, self.settled = targets or {}, fraction, rounds, settled

    @staticmethod
    def uniform(doc_id: str, text: str) -> Column:
        digits = F.substring(F.md5(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.col(text), F.lit("")).cast("binary")), 1, 8)
        return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)

    @staticmethod
    def described(docs: DataFrame) -> DataFrame:
        """doc_id, the cell's columns, tokens and the uniform number of every row."""
        rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("source").cast("string"), F.lit("(none)")).alias("source"),
            F.coalesce(F.col("lang").cast("string"), F.lit("(none)")).alias("lang"),
            F.col("text").cast("string").alias("text"),
        )
        rows = with_topic(rows, F.col("text"), "topic", "words")
        return rows.select("doc_id", "source", "lang", "topic", F.size("words").cast("long").alias("tokens"), Raking.uniform("doc_id", "text").alias("u"))

    def _goal(self, cells: DataFrame, dim: str) -> DataFrame:
        sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
        raw = F.pow(F.col("t").cast("double"), F.lit(float(self.temper[dim])))
        given = self.targets.get(dim, {})
        named = F.lit(None).cast("double")
        for value, share in given.items():
            named = F.when(F.col(dim) == value, F.lit(float(share))).otherwise(named)
        left = sums.agg(F.sum(F.when(named.isNull(), raw)).alias("free"))  # one row
        return sums.join(F.broadcast(left)).select(dim, F.coalesce(named, F.lit(1.0 - sum(given.values())) * raw / F.col("free")).alias(f"goal_{dim}"))

    def _swept(self, cells: DataFrame) -> DataFrame:
        for dim in DIMS:
            over = Window.partitionBy(dim)
            free, whole = F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(over), F.sum(F.when(F.col("full"), F.col("tokens")).otherwise(0)).over(over)
            left = F.greatest(F.lit(0.0), F.col(f"goal_{dim}") * F.col("kept") - whole)
            cells = cells.withColumn("w", F.when(F.col("full"), F.col("tokens").cast("double")).when(free > 0, F.col("w") * left / free).otherwise(F.col("w")))
        return cells

    def cells(self, described: DataFrame) -> DataFrame:
        """(source, lang, topic, tokens, weight, p, goal_*): tokens to keep as shares of all kept, and probabilities.

        A table of few cells is raked in one partition, so that sweeps need no shuffle; a larger one by shuffles.
        """
        cells = materialize(described.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")))
        one = (lambda df: df.coalesce(1)) if cells.limit(100_001).count() <= 100_000 else lambda df: df
        total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        out = cells.withColumns({"w": F.col("tokens") * F.lit(self.fraction), "full": F.col("tokens") == 0, "kept": F.lit(self.fraction * total)})
        for dim in DIMS:
            out = out.join(F.broadcast(self._goal(cells, dim)) if one(cells) is not cells else self._goal(cells, dim), dim)
        out = materialize(one(out))
        for _ in range(self.rounds if total else 0):
            new = one(out).withColumn("was", F.col("w"))
            for _ in range(SWEEPS):
                new = self._swept(new)
            over = ~F.col("full") & (F.col("w") > F.col("tokens") * F.lit(1 + 1e-9))
            moved = F.abs(F.col("w") - F.col("was")) > F.lit(self.settled * total)
            new = materialize(new.withColumns({"moved": moved | over, "full": F.col("full") | over}))
            out = new.drop("was", "moved")
            if new.where("moved").limit(1).count() == 0:
                break
        w = F.when(F.col("full"), F.col("tokens").cast("double")).otherwise(F.least("w", F.col("tokens").cast("double")))
        p = F.when(F.col("tokens") > 0, w / F.col("tokens")).otherwise(1.0)
        kept = F.greatest(F.col("kept"), F.lit(1e-300))
        return out.select(*DIMS, "tokens", (w / kept).alias("weight"), p.alias("p"), *[f"goal_{d}" for d in DIMS])

    @staticmethod
    def report(cells: DataFrame) -> DataFrame:
        """dim, value, goal, got: each marginal's target share and the share that the cells give."""
        parts = [cells.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.max(f"goal_{d}").alias("goal"), F.sum("weight").alias("got")) for d in DIMS]
        return reduce(DataFrame.union, parts)

    def sample(self, docs: DataFrame) -> DataFrame:
        """Per input row: its cell, tokens, cell weight, probability and whether it is kept."""
        rows = materialize(self.described(docs))
        cells = self.cells(rows).drop("tokens")
        out = rows.join(sized(cells, 100_000), list(DIMS))
        return out.select("doc_id", *DIMS, "tokens", F.round("weight", 7).alias("weight"), F.round("p", 6).alias("p"), (F.col("u") < F.col("p")).alias("kept"))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The sampled rows of ``docs``, with its columns, whatever their names."""
        names = {n: free_name(docs, n) for n in ("cell_source", "cell_lang", "cell_topic", "cell_p")}
        cells = self.cells(self.described(docs)).select(*(F.col(d).alias(names[f"cell_{d}"]) for d in DIMS), F.col("p").alias(names["cell_p"]))
        own = {names[f"cell_{d}"]: F.coalesce(F.col(d).cast("string"), F.lit("(none)")) for d in ("source", "lang")}
        out = with_topic(docs, F.col("text").cast("string"), names["cell_topic"], free_name(docs, "cell_words")).withColumns(own).join(sized(cells, 100_000), [names[f"cell_{d}"] for d in DIMS])
        return out.where(self.uniform("doc_id", "text") < F.col(names["cell_p"])).select(*docs.columns)

    def sql(self, rounds: int = 40) -> str:
        """DuckDB SQL for ``sample`` on ``documents``, with targets from tempers alone."""
        quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"
        counts = [f"len(list_intersect(l, {quoted(lot)}))" for lot in TOPICS.values()]
        names = "".join(f" when n[{i}] = list_max(n) then '{t}'" for i, t in enumerate(TOPICS, 1))
        sweep = "s"
        for _ in range(SWEEPS):
            for d in DIMS:
                sweep = (
                    f"(select * exclude (w, free, whole), case when is_full then tokens when free > 0 then w * greatest(0, goal_{d} * kept - whole) / free else w end w "
                    f"from (select *, sum(case when is_full then 0 else w end) over (partition by {d}) free, sum(case when is_full then tokens else 0 end) over (partition by {d}) whole from {sweep}))"
                )
        goals = ", ".join(f"goal_{d} as (select {d}, pow(t, {float(self.temper[d])}) / sum(pow(t, {float(self.temper[d])})) over () goal_{d} from (select {d}, sum(tokens)::double t from cells group by {d}))" for d in DIMS)
        return rf"""with recursive split as materialized (select doc_id, coalesce(source, '(none)') source, coalesce(lang, '(none)') lang, text,
   list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') l from documents),
 docs as materialized (select doc_id, source, lang, case when list_max(n) = 0 then 'general'{names} end topic, tokens, u from (select *, [{", ".join(counts)}] n, len(l) tokens,
   ('0x' || substr(md5(coalesce(doc_id::varchar, text, '')), 1, 8))::bigint / 4294967296.0 u from split)),
 cells as materialized (select source, lang, topic, sum(tokens)::bigint tokens from docs group by all), {goals},
 s as (select 0 k, source, lang, topic, tokens, tokens = 0 is_full, {self.fraction} * sum(tokens) over () kept, goal_source, goal_lang, goal_topic, tokens * {self.fraction}::double w
   from cells join goal_source using (source) join goal_lang using (lang) join goal_topic using (topic)
  union all select k + 1, source, lang, topic, tokens, is_full or w > tokens * (1 + 1e-9), kept, goal_source, goal_lang, goal_topic, w from {sweep} where k < {rounds}),
 probs as (select source, lang, topic, x / kept weight, case when tokens > 0 then x / tokens else 1.0 end p from (select *, case when is_full then tokens::double else least(w, tokens) end x from s where k = {rounds}))
 select doc_id, source, lang, topic, tokens::bigint tokens, round(weight, 7) weight, round(p, 6) p, u < p kept from docs join probs using (source, lang, topic)"""

"""Full-text search: postings, BM25, boolean search and a small query language.

Postings are one pass over the texts.  A query touches only rows with its
terms: the number of documents, their mean length and the frequencies of the
query's terms are aggregates, and scores sum in one shuffle on the document id.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..functions import text as T
from ..functions.vector import let

K1, B = 1.2, 0.75


def idf(total: Column, df: Column) -> Column:
    """Negative for terms in more than half of the documents."""
    return F.log((total - df + 0.5) / (df + 0.5))


def bm25(idf_: Column, tf: Column, length: Column, mean: Column) -> Column:
    mean = F.when(mean == 0, F.lit(1.0)).otherwise(mean)
    return idf_ * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


@dataclass(frozen=True)
class Node:
    """op is term, phrase, and, or, not."""

    op: str
    term: str = ""
    children: tuple[Node, ...] = ()


def lex(query: str) -> list[str]:
    out, now, quoted = [], "", False

    def end():
        nonlocal now
        if now:
            out.append(f'"{now}"' if quoted else now)
        now = ""

    for c in query:
        if c == '"':
            end()
            quoted = not quoted
        elif not quoted and (c.isspace() or c in "()"):
            end()
            if c in "()":
                out.append(c)
        else:
            now += c
    quoted = False  # an unclosed phrase ends as a plain token
    end()
    return out


class Parser:
    """OR binds least; AND and NOT are of one level, left to right; then prefix NOT, parentheses, phrases, terms.

    What stands beside a complete expression without an operator is not read.
    """

    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def word(self) -> str:
        return self.tokens[self.at].upper() if self.at < len(self.tokens) else ""

    def level(self, signs: tuple[str, ...], inner) -> Node | None:
        left = inner()
        while left and self.word() in signs:
            sign = self.word().lower()
            self.at += 1
            right = inner()
            if right is None:
                break
            left = Node(sign, children=(left, right))
        return left

    def expression(self) -> Node | None:
        return self.level(("OR",), lambda: self.level(("AND", "NOT"), self.prefix))

    def prefix(self) -> Node | None:
        if self.word() != "NOT":
            return self.primary()
        self.at += 1
        child = self.primary()
        return child and Node("not", children=(child,))

    def primary(self) -> Node | None:
        if self.at >= len(self.tokens):
            return None
        token = self.tokens[self.at]
        self.at += 1
        if token == "(":
            inner = self.expression()
            if self.word() == ")":
                self.at += 1
            return inner
        if len(token) > 1 and token[0] == token[-1] == '"':
            return Node("phrase", token[1:-1])
        return Node("term", token.lower())


def parse(query: str) -> Node | None:
    return Parser(lex(query)).expression()


@dataclass
class FtsIndex:
    """Search over df's text column; results are (key, score, text) by score, then key."""

    df: DataFrame
    field: str
    key: str = "id"
    tokenizer: str = "standard"
    filters: tuple = ()
    words: list[str] | None = None

    def __post_init__(self):
        self.cut = T.tokenizer(self.tokenizer, self.filters, self.words)
        self.tokens = self.df.where(F.col(self.field).isNotNull()).select(F.col(self.key).alias("key"), F.col(self.field).alias("text"), self.cut(F.col(self.field)).alias("tokens"))

    @cached_property
    def postings(self) -> DataFrame:
        """(term, key, positions, tf, length)."""
        rows = self.tokens.select("key", F.size("tokens").alias("length"), F.posexplode("tokens").alias("at", "term"))
        return rows.groupBy("term", "key").agg(F.sort_array(F.collect_list("at")).alias("positions"), F.count("*").alias("tf"), F.first("length").alias("length"))

    def stats(self) -> DataFrame:
        """(total, mean): number of documents and their mean length in tokens; one row."""
        return self.tokens.agg(F.count("*").alias("total"), F.coalesce(F.avg(F.size("tokens").cast("double")), F.lit(0.0)).alias("mean"))

    def doc_freq(self) -> DataFrame:
        """(term, df, idf) of every term."""
        n = self.stats().select("total")
        rows = self.tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        return rows.crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("total"), F.col("df")).alias("idf"))

    def query_tokens(self, query: str) -> list[str]:
        one = self.df.sparkSession.createDataFrame([(query,)], "q string").select(self.cut(F.col("q")).alias("t")).first()
        return list(one.t or [])

    def hits(self, terms: list[str]) -> DataFrame:
        """(key, text, term, positions, tf, length, idf, mean) of the rows that have any of the terms."""
        wanted = F.array(*[F.lit(t) for t in terms])
        has = self.tokens.where(F.arrays_overlap("tokens", wanted))
        at = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("at"))), lambda x: F.array_contains(wanted, x["term"]))
        rows = has.select("key", "text", F.size("tokens").alias("length"), F.explode(F.array_distinct(F.transform(at, lambda x: x["term"]))).alias("term"), at.alias("found"))
        rows = rows.select("key", "text", "term", "length", F.transform(F.filter("found", lambda x: x["term"] == F.col("term")), lambda x: x["at"]).alias("positions"))
        rows = rows.withColumn("tf", F.size("positions"))
        df = rows.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term at most
        df = df.crossJoin(self.stats()).select("term", idf(F.col("total"), F.col("df")).alias("idf"), "mean")
        return rows.join(F.broadcast(df), "term")

    def _empty(self) -> DataFrame:
        return self.tokens.where(F.lit(False)).select("key", F.lit(0.0).alias("score"), "text")

    def _cut(self, rows: DataFrame, k: int) -> DataFrame:
        if k <= 0:
            raise InvalidArgument("k must be above 0")
        return rows.orderBy(F.desc("score"), "key").limit(k).select(F.col("key").alias(self.key), "score", "text")

    def search(self, query: str, k: int) -> DataFrame:
        """Bag of words: any token; a token repeated in the query multiplies its frequency."""
        times = Counter(self.query_tokens(query))
        if not times:
            return self._cut(self._empty(), k)
        n = F.create_map(*[F.lit(x) for pair in times.items() for x in pair])
        part = bm25(F.col("idf"), F.col("tf") * F.element_at(n, F.col("term")), F.col("length"), F.col("mean"))
        return self._cut(self.hits(list(times)).groupBy("key").agg(F.sum(part).alias("score"), F.first("text").alias("text")), k)

    def boolean(self, query: str, op: str, k: int) -> DataFrame:
        """Score is the number of query tokens found, repeats counted; AND needs all of them."""
        times = Counter(self.query_tokens(query))
        if not times:
            return self._cut(self._empty(), k)
        found = sum((F.when(F.array_contains("tokens", t), n).otherwise(0) for t, n in times.items()), F.lit(0))
        rows = self.tokens.select("key", "text", found.cast("double").alias("score"))
        return self._cut(rows.where(F.col("score") >= (sum(times.values()) if op.upper() == "AND" else 1)), k)

    def advanced(self, query: str, k: int) -> DataFrame:
        """The query language; scores of AND and OR add, NOT takes away."""
        node = parse(query)
        rows = self.evaluate(node) if node else self._empty().select("key", "score")
        texts = self.tokens.select("key", "text")
        return self._cut(rows.join(texts, "key"), k)

    def evaluate(self, node: Node) -> DataFrame:
        """(key, score)."""
        if node.op == "term":
            return self.term(node.term)
        if node.op == "phrase":
            return self.phrase(node.term)
        parts = [self.evaluate(c) for c in node.children]
        if node.op == "and":
            a, b = parts[0], parts[1].withColumnRenamed("score", "more")
            return a.join(b, "key").select("key", (F.col("score") + F.col("more")).alias("score"))
        if node.op == "or":
            return parts[0].unionByName(parts[1]).groupBy("key").agg(F.sum("score").alias("score"))
        if len(parts) == 1:
            return self.tokens.select("key").join(parts[0], "key", "left_anti").select("key", F.lit(0.0).alias("score"))
        return parts[0].join(parts[1], "key", "left_anti")

    def term(self, term: str) -> DataFrame:
        """BM25 of one token as it stands."""
        return self.hits([term]).select("key", bm25(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean")).alias("score"))

    def phrase(self, phrase: str) -> DataFrame:
        """Consecutive tokens; the number of occurrences is the frequency of each of them."""
        tokens = self.query_tokens(phrase)
        if not tokens:
            return self._empty().select("key", "score")
        if len(tokens) == 1:
            return self.term(tokens[0])
        own = F.col("tokens")
        fits = lambda t, i: reduce(lambda a, b: a & b, [F.get(t, i + j) == w for j, w in enumerate(tokens)])
        starts = let(own, lambda t: F.filter(F.sequence(F.lit(0), F.greatest(F.size(t) - len(tokens), F.lit(0))), lambda i: fits(t, i)))
        rows = self.tokens.where(F.size(own) >= len(tokens)).where(F.array_contains(own, tokens[0]))
        rows = rows.select("key", F.size(own).alias("length"), F.size(starts).alias("tf")).where("tf > 0")
        df = self.tokens.agg(*[F.count_if(F.array_contains(own, t)).alias(f"df{i}") for i, t in enumerate(tokens)], F.count("*").alias("total"), F.avg(F.size(own).cast("double")).alias("mean"))
        rows = rows.crossJoin(F.broadcast(df))  # one row
        parts = [bm25(idf(F.col("total"), F.col(f"df{i}")), F.col("tf"), F.col("length"), F.col("mean")) for i in range(len(tokens))]
        return rows.select("key", sum(parts[1:], parts[0]).alias("score"))

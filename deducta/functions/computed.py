"""Computed relations: read-only table functions with arguments that must be bound."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.algebra import positional
from ..operators.pattern import ANY, Var, bound
from ..values import RelationError


@dataclass(frozen=True)
class Computed:
    """make gets the bound arguments by position and returns a DataFrame with all columns."""

    name: str
    columns: tuple[str, ...]
    required: tuple[int, ...]
    make: Callable[[dict[int, object]], DataFrame]

    def scan(self, *terms: object) -> DataFrame:
        """The rows that match terms (constants, Var or ANY)."""
        if len(terms) != len(self.columns):
            raise RelationError("E_ARITY", f"{self.name} has {len(self.columns)} columns")
        given = {i: t for i, t in enumerate(terms) if t is not ANY and not isinstance(t, Var)}
        if missing := [self.columns[i] for i in self.required if i not in given]:
            raise RelationError("E_BINDING", f"{self.name} needs {', '.join(missing)}")
        return bound(self.make(given).select(*self.columns), *terms)


class Registry:
    def __init__(self):
        self.by_name: dict[str, Computed] = {}

    def register(self, computed: Computed) -> Computed:
        self.by_name[computed.name] = computed
        return computed

    def scan(self, name: str, *terms: object) -> DataFrame:
        if name not in self.by_name:
            raise RelationError("E_RELATION", f"no computed relation {name}")
        return self.by_name[name].scan(*terms)

    def assert_(self, name: str, *_: object) -> None:
        raise RelationError("E_READ_ONLY", f"{name} is computed")


# nearest embeddings


def cosine(a: Column, b: Column) -> Column:
    """Exact cosine of two arrays in binary64. Other sizes, empty arrays and zero lengths are errors."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    length = lambda z: F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, v: s + v * v))
    bad = (F.size(x) != F.size(y)) | (F.size(x) == 0)
    zero = (length(x) == 0) | (length(y) == 0)
    return F.when(bad, F.raise_error(F.lit("E_VECTOR: empty vector or other size")).cast("double")).when(zero, F.raise_error(F.lit("E_VECTOR: zero length")).cast("double")).otherwise(dot / (length(x) * length(y)))


def nearest(embeddings: DataFrame, query: list[float], k: int, subject: str, vector: str) -> DataFrame:
    """subject, score (binary32): each subject's best score, the k best, ties by subject. Scores are summed up before anything
    moves; the top k never leaves a task with more than k rows."""
    if k < 0:
        raise RelationError("E_INDEX", "k is negative")
    scored = embeddings.select(F.col(subject).alias("subject"), cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("s"))
    best = scored.groupBy("subject").agg(F.max("s").alias("s"))
    return best.orderBy(F.desc("s"), "subject").limit(k).select("subject", F.col("s").cast("float").alias("score"))


def nearest_embedding(contains: DataFrame, of: DataFrame, vectors: DataFrame, version: int = 0) -> Computed:
    """NearestEmbedding(index, query, k, subject, score, version) over contains (index, embedding), of (embedding, subject) and
    vectors (embedding, vector). query is an embedding."""

    def make(given: dict[int, object]) -> DataFrame:
        index, query, k = given[0], given[1], given[2]
        row = bound(positional(vectors), query, ANY).limit(2).collect()
        if len(row) != 1:
            raise RelationError("E_CARDINALITY", "the query embedding has no vector")
        inside = bound(positional(contains), index, ANY).select(F.col("c1").alias("e"))
        pool = inside.join(positional(of).toDF("e", "subject"), "e").join(positional(vectors).toDF("e", "vector"), "e")
        found = nearest(pool, list(row[0][1]), int(k), "subject", "vector")
        return found.select(F.lit(index).alias("index"), F.lit(query).alias("query"), F.lit(k).alias("k"), "subject", "score", F.lit(version).alias("version"))

    return Computed("NearestEmbedding", ("index", "query", "k", "subject", "score", "version"), (0, 1, 2), make)


# text search

#: Scores of a match of the whole query, of a term, and of a symbol in a unit.
QUERY_SCORES = {"path": 260, "title": 210, "text": 120}
TERM_SCORES = {"path": 110, "title": 95, "text": 55, "kind": 20}
FILE_SCORES = {"equal": 240, "contains": 180}
SYMBOL_SCORES = {"equal": 320, "contains": 190}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search_terms(query: str) -> list[str]:
    low = query.translate({c: c + 32 for c in range(65, 91)})
    return sorted(set(re.findall(r"[a-z0-9_-]+", low)))


#: Fixed values below: the folders and endings by which a path has its scope.
def text_scope(path: Column) -> Column:
    return (
        F.when(path.startswith("sketches/"), "sketches")
        .when(path.contains("/benches/") | path.startswith("benches/"), "benches")
        .when(path.contains("/tests/") | path.startswith("tests/") | path.endswith("_test.rs"), "tests")
        .when(path.endswith(".md") | path.endswith(".markdown") | path.startswith("docs/"), "docs")
        .otherwise("code")
    )


def snippet(text: Column, path: Column, title: Column, query: str, terms: list[str]) -> Column:
    """70 characters before the first match and 190 from it; dots mark what is cut off."""
    low_query = query.translate({c: c + 32 for c in range(65, 91)})
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))

    def around(body: Column) -> Column:
        low = ascii_lower(body)
        at = F.instr(low, low_query) if low_query else F.lit(0)
        places = [F.when(F.instr(low, t) > 0, F.instr(low, t)) for t in terms]
        first = places[0] if len(places) == 1 else F.least(*places)
        found = F.when(at > 0, at).otherwise(first) - 1
        start = F.greatest(found - 70, F.lit(0))
        cut = F.substring(body, start + 1, found + 190 - start)
        return F.when(found.isNotNull(), F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(F.char_length(body) > found + 190, "...").otherwise("")))

    whole = squeeze(F.concat_ws(" ", path, title, text))
    return F.coalesce(around(squeeze(text)), around(whole), F.substring(whole, 1, 260))


def text_search(units: DataFrame, query: str, limit: int | None, scope: str = "all", symbols: DataFrame | None = None) -> DataFrame:
    """unit, score, path, match_line, kind, title, snippet of the best units: by score, path, line and unit. units: repository, unit,
    ordinal, kind, title, path, start_line, end_line, model, text; symbols: repository, path, name, start_line, end_line. Without a
    limit all hits, in no order."""
    terms, low_query = search_terms(query), query.translate({c: c + 32 for c in range(65, 91)})
    rows = units if scope not in ("docs", "code", "tests", "benches", "sketches") else units.filter(text_scope(F.col("path")) == scope)
    if not terms:
        rows = rows.limit(0)
    low = {c: ascii_lower(F.col(c)) for c in ("path", "title", "kind", "text")}
    file = ascii_lower(F.substring_index("path", "/", -1))
    score = sum((F.when(low[c].contains(low_query), n).otherwise(0) for c, n in QUERY_SCORES.items()), F.lit(0))
    for t in terms:
        score = score + F.when(file == t, FILE_SCORES["equal"]).when(file.contains(t), FILE_SCORES["contains"]).otherwise(0)
        score = score + sum((F.when(low[c].contains(t), n).otherwise(0) for c, n in TERM_SCORES.items()), F.lit(0))
    # the line, in the unit's text, of the first match of the query, else of a term
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x: ascii_lower(x))
    at = lambda needle: F.array_position(F.transform(lines, lambda x: x.contains(needle)), True)
    hit = F.coalesce(F.nullif(at(low_query), F.lit(0).cast("long")), *([F.least(*ts) if len(ts := [F.nullif(at(t), F.lit(0).cast("long")) for t in terms]) > 1 else ts[0]] if terms else []))
    own = rows.withColumn("__score", score).withColumn("__line", (F.col("start_line") + F.greatest(hit - 2, F.lit(0))).cast("int"))
    if symbols is not None:
        name = ascii_lower(F.col("name"))
        wanted = name.contains(low_query)
        for t in terms:
            wanted = wanted | name.contains(t)
        s = symbols.filter(wanted).select(F.col("repository").alias("r"), F.col("path").alias("p"), "name", F.col("start_line").alias("a"), F.col("end_line").alias("b"))
        overlap = (F.col("repository") == F.col("r")) & (F.col("path") == F.col("p")) & (F.col("a") <= F.col("end_line")) & (F.col("start_line") <= F.col("b"))
        extra = own.join(s, overlap).groupBy("unit").agg(F.sum(F.when(ascii_lower(F.col("name")) == low_query, SYMBOL_SCORES["equal"]).otherwise(SYMBOL_SCORES["contains"])).alias("__more"), F.min("a").alias("__a"))
        own = own.join(extra, "unit", "left").withColumn("__score", F.col("__score") + F.coalesce("__more", F.lit(0))).withColumn("__line", F.coalesce("__line", F.col("__a").cast("int")))
    found = own.filter("__score > 0").select("unit", F.col("__score").cast("int").alias("score"), "path", F.coalesce("__line", F.col("start_line").cast("int")).alias("match_line"), "kind", "title", snippet(F.col("text"), F.col("path"), F.col("title"), query, terms or [""]).alias("snippet"))
    return found if limit is None else found.orderBy(F.desc("score"), "path", "match_line", "unit").limit(limit)


#: Bounds of a text unit.
CHUNK_LINES, CHUNK_BYTES = 40, 1_200


def chunk_lines(text: str, lines: int = CHUNK_LINES, size: int = CHUNK_BYTES) -> list[tuple[int, int, str]]:
    """First line, last line and text of chunks of consecutive lines, each as long as both bounds allow. A line beyond the size is cut
    between characters. Blank chunks are left out."""
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    first = used = 0

    def flush() -> None:
        nonlocal used
        if held:
            out.append((first, first + len(held) - 1, "\n".join(held)))
            held.clear()
        used = 0

    own = text.split("\n")
    if own and not own[-1]:
        own.pop()
    for n, line in enumerate(own, 1):
        line = line.removesuffix("\r")
        raw = line.encode("utf-8", "surrogatepass")
        if held and (len(held) >= lines or used + 1 + len(raw) > size):
            flush()
        if len(raw) > size:
            while raw:
                cut = min(size, len(raw))
                while cut < len(raw) and raw[cut] & 0xC0 == 0x80:
                    cut -= 1
                out.append((n, n, raw[:cut].decode("utf-8", "surrogatepass")))
                raw = raw[cut:]
            continue
        if not held:
            first = n
        used += len(raw) + bool(held)
        held.append(line)
    flush()
    return [c for c in out if c[2].strip()]


def text_units(files: DataFrame, repository: str = "repository", path: str = "path", text: str = "text", lines: int = CHUNK_LINES, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of each file: repository, path, ordinal, start_line, end_line, title, text. A file's state decides where a chunk ends, so
    it is an Arrow-batched function of a file; nothing is shuffled."""

    @F.pandas_udf("array<struct<start_line:int,end_line:int,text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("start_line", "end_line", "text"), c, strict=True)) for c in chunk_lines(t or "", lines, size)])

    rows = files.select(F.col(repository).alias("repository"), F.col(path).alias("path"), F.posexplode(cut(F.col(text))).alias("n", "u")).select("repository", "path", (F.col("n") + 1).alias("ordinal"), "u.start_line", "u.end_line", "u.text")
    title = F.concat(F.col("path").cast("string"), F.lit(":"), F.when(F.col("start_line") == F.col("end_line"), F.col("start_line").cast("string")).otherwise(F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string"))))
    return rows.select("repository", "path", "ordinal", "start_line", "end_line", title.alias("title"), "text")


def _lines(text: Column) -> Column:
    """Lines without their ends; a last end starts no line."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def file_lines(files: DataFrame, path: str, text: str) -> DataFrame:
    """path, line (from 1), text."""
    return files.select(F.col(path).alias("path"), F.posexplode(_lines(F.col(text))).alias("n", "text")).select("path", (F.col("n") + 1).alias("line"), "text")


def file_line_count(files: DataFrame, path: str, text: str) -> DataFrame:
    return files.select(F.col(path).alias("path"), F.size(_lines(F.col(text))).alias("lines"))


def file_content_hash(files: DataFrame, path: str, text: str) -> DataFrame:
    return files.select(F.col(path).alias("path"), F.sha2(F.col(text), 256).alias("sha256"))


# facts about a subject


def _subject_columns(df: DataFrame, name: str, subject: Column, positions: list[int] | None) -> list[DataFrame]:
    own = positional(df)
    cells = F.transform(F.array(*[F.to_json(F.array(F.col(c))) for c in own.columns]), lambda x: x.substr(F.lit(2), F.char_length(x) - 2))
    return [own.filter(F.col(own.columns[i]) == subject).select(F.lit(name).alias("relation"), F.lit(i).alias("position"), cells.alias("tuple")) for i in (range(len(own.columns)) if positions is None else positions) if i < len(own.columns)]


def subject_facts(relations: dict[str, DataFrame], subject: object, kind: str = "int") -> DataFrame:
    """relation, tuple (cells as literals) of facts whose first cell is the subject. Only columns of the subject's kind are read."""
    return mentioned_facts(relations, subject, kind, [0]).drop("position").distinct()


def mentioned_facts(relations: dict[str, DataFrame], subject: object, kind: str = "int", positions: list[int] | None = None) -> DataFrame:
    """relation, position, tuple of facts that hold the subject at any (or a given) position."""
    from ..values import kind_of

    parts = []
    for name, df in relations.items():
        own = positional(df)
        at = [i for i, f in enumerate(own.schema.fields) if kind_of(f.dataType) == kind and (positions is None or i in positions)]
        parts += _subject_columns(df, name, F.lit(subject), at)
    if not parts:
        raise RelationError("E_RELATION", f"no relation holds values of kind {kind}")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def extensional_mentioned_facts(store, subject: object, kind: str = "int") -> DataFrame:
    """Like mentioned_facts, of the stored relations of a store alone; what its rules derive is left out."""
    return mentioned_facts({n: store.read(n) for n in store.catalog.relations}, subject, kind)

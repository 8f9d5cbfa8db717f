"""The index: symbols of source files, postings, document frequencies, corpus statistics, import and call edges.

Symbols are declarations at the start of a line, which reach to the next one; methods inside a class, which
reach to the next method or the end of the class; test cases, which reach to the next one; and configuration
files without any of these, as one module. ``sym_id`` is the file's id and the place in it, so it follows the
discovery order and can end every ranking as the last tie-breaker. Statistics are those of one project, as every
task is asked in one. Defined results: null texts have no symbols; repeated files are files of their own; file ids
are below 2^32.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import constants as C
from sieveline.functions import text as X

DECLARATION = r"(?m)^((?:export |default |async |abstract )*)(function|class|interface|enum|type|const|def) +([A-Za-z_$][A-Za-z0-9_$]*)"
MARK = "\u0001"
#: Kinds by the declaring word.
KINDS = {"function": "function", "def": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "type", "const": "variable"}
#: Methods of a class and the words that only look like one.
MEMBER = r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set|abstract|def) +)*(#?[A-Za-z_$][A-Za-z0-9_$]*)\([^()\n]*\)[^;{}()\n]*(?:\{[^\n]*|:[ \t\r]*)\n"
NO_MEMBERS = ["if", "for", "while", "switch", "catch", "with", "function", "return", "super"]
TEST_CASE = r"""(?m)^[ \t]*(?:it|test)(?:\.[a-z]+)*(?:\([^()\n]*\))?\([ ]*["'`]([^"'`\n]+)["'`]"""
#: Bits of a symbol's id that hold its place in the file.
PLACE_BITS = 31


def _cut(rows: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """One row per match of a line pattern: the kept columns, ``chunk`` (to the next match or the end) and ``at``."""
    parts = F.split(F.regexp_replace(text, pattern, MARK + "$0"), MARK)
    cut = rows.select(*keep, parts.alias("_parts")).select(*keep, "_parts", F.posexplode("_parts").alias("ord", "chunk")).where("ord > 0")
    at = F.aggregate(F.slice("_parts", F.lit(1), F.col("ord")), F.lit(0), lambda a, x: a + F.length(x))
    return cut.select(*keep, "chunk", at.alias("at"))


def _signature(chunk: str = "chunk") -> F.Column:
    first = F.element_at(F.split(chunk, "\r?\n"), 1)
    return F.trim(F.regexp_replace(first, r"[ ]*[{:]?[ ]*$", ""))


def _as_symbols(found: DataFrame, symbol: F.Column, kind: F.Column, signature: F.Column) -> DataFrame:
    return found.select(
        "file_id", "project", "file", symbol.alias("symbol"), kind.alias("kind"), F.col("at").alias("start"), (F.col("at") + F.length("chunk")).alias("end"),
        signature.alias("signature"), F.col("chunk").alias("source_text"),
    )


def declarations(files: DataFrame) -> DataFrame:
    place = ("file_id", "project", "file")
    chunks = _cut(files.where("text is not null").withColumn("file", F.col("relative")), "text", DECLARATION, *place)
    word = F.regexp_extract("chunk", DECLARATION, 2)
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[word]
    first = F.element_at(F.split("chunk", "\r?\n"), 1)
    signature = F.when(word == "const", F.trim(F.element_at(F.split(first, "=", 2), 1))).otherwise(_signature())
    return _as_symbols(chunks, F.regexp_extract("chunk", DECLARATION, 3), kind, signature)


def members(declared: DataFrame) -> DataFrame:
    """The methods of the classes among ``declared``."""
    classes = declared.where("kind = 'class'").withColumnRenamed("start", "_class")
    found = _cut(classes, "source_text", MEMBER, "file_id", "project", "file", "_class").withColumn("at", F.col("_class") + F.col("at"))
    name = F.regexp_extract("chunk", MEMBER, 1)
    return _as_symbols(found.where(~name.isin(NO_MEMBERS)), name, F.lit("method"), _signature())


def test_cases(files: DataFrame) -> DataFrame:
    """Test calls by their titles, of at most 240 characters."""
    found = _cut(files.where("text is not null").withColumn("file", F.col("relative")), "text", TEST_CASE, "file_id", "project", "file")
    title = F.substring(F.trim(F.regexp_extract("chunk", TEST_CASE, 1)), 1, 240)
    return _as_symbols(found, title, F.lit("test"), _signature()).where("symbol <> ''")


def config_modules(files: DataFrame) -> DataFrame:
    """Configuration files without declarations and test cases stand for one module of their name."""
    configs = files.where("text is not null").where(F.col("relative").rlike(X.CONFIG_NAME))
    bare = configs.where(~F.col("text").rlike(DECLARATION) & ~F.col("text").rlike(TEST_CASE))
    name = F.element_at(F.split("relative", "/"), -1)
    whole = bare.select("file_id", "project", F.col("relative").alias("file"), F.col("text").alias("chunk"), F.lit(0).alias("at"), name.alias("_name"))
    return _as_symbols(whole, F.col("_name"), F.lit("module"), F.col("_name"))


def symbols(files: DataFrame) -> DataFrame:
    """One row per symbol of ``files(file_id, project, relative, text)``.

    ``body`` is what the index reads of it, ``source_text`` the whole symbol.
    """
    declared = declarations(files)
    found = declared.unionByName(members(declared)).unionByName(test_cases(files)).unionByName(config_modules(files))
    most = F.when(F.col("kind").isin("test", "module"), C.TEST_BODY_CHARS).otherwise(C.BODY_CHARS)
    body = F.substring(F.col("source_text"), F.lit(1), most.cast("int"))
    sym_id = F.call_function("shiftleft", F.col("file_id").cast("bigint"), F.lit(PLACE_BITS)) + F.col("start")
    return found.select(sym_id.alias("sym_id"), *found.columns[:8], body.alias("body"), "source_text")


def fields(found: DataFrame) -> DataFrame:
    """sym_id with the four token lists."""
    return found.select(
        "sym_id",
        "file_id",
        "project",
        X.tokenize(F.col("symbol")).alias("name"),
        X.tokenize(F.col("file")).alias("path"),
        X.tokenize(F.col("signature")).alias("signature"),
        X.tokenize(F.col("body")).alias("body"),
    )


def _bag() -> F.Column:
    return F.concat("name", "path", "signature", F.slice("body", 1, C.BAG_BODY_TOKENS))


def doc_freq(tokens: DataFrame) -> DataFrame:
    """(project, term, df): symbols of the project whose bag (all fields, the body up to its 80th token) holds the term."""
    return tokens.select("project", F.explode(F.array_distinct(_bag())).alias("term")).groupBy("project", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """(project, n, avgdl); the name counts twice in the length of a bag."""
    length = F.size("name") + F.size(_bag())
    count = F.count(F.lit(1))
    return tokens.groupBy("project").agg(count.alias("n"), (F.sum(F.greatest(length, F.lit(1))) / count).alias("avgdl"))


#: The names between braces may stand on several lines.
IMPORT_LINE = r"""(?m)^import\s[^'"\n{]*(?:\{[^{}'"]*\}[^'"\n]*)?['"]([^'"\n]+)['"]"""
CALL = r"([A-Za-z_$][A-Za-z0-9_$]*)\("


def import_specifiers(files: DataFrame) -> DataFrame:
    """(file_id, project, file, specifier): distinct specifiers of import declarations."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(IMPORT_LINE), F.lit(1)))
    return files.where("text is not null").select("file_id", "project", F.col("relative").alias("file"), F.explode(found).alias("specifier"))


def callees(files: DataFrame) -> DataFrame:
    """(file_id, project, file, name): distinct names that a file calls."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(CALL), F.lit(1)))
    return files.where("text is not null").select("file_id", "project", F.col("relative").alias("file"), F.explode(found).alias("name"))


def normalized_path(path):
    """The path with ``.`` and ``..`` segments resolved."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")

    def step(done, segment):
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment == "..", up).otherwise(F.concat(done, F.array(segment)))

    return F.array_join(F.aggregate(segments, empty, step), "/")


def alias_rules(configs: DataFrame) -> DataFrame:
    """(project, prefix, exact, target, rule): path aliases of ``configs(project, text)``, compiler options as JSON."""
    options = F.from_json("text", "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")
    rules = configs.select("project", options.alias("o")).select(
        "project", F.coalesce("o.compilerOptions.baseUrl", F.lit("")).alias("base"), F.posexplode("o.compilerOptions.paths").alias("rule", "key", "targets")
    )
    target = F.concat_ws("/", F.col("base"), F.col("t"))
    return rules.select("project", "base", "rule", "key", F.posexplode("targets").alias("nth", "t")).select(
        "project",
        F.element_at(F.split("key", r"\*"), 1).alias("prefix"),
        (~F.col("key").contains("*")).alias("exact"),
        target.alias("target"),
        (F.col("rule") * 1000 + F.col("nth")).cast("int").alias("rule"),
    )


def _bases(asked: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(project, file, specifier, base, nth): where a specifier may point, in the order in which it is tried."""
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    key = ["project", "file", "specifier"]
    near = asked.where("specifier like '.%'").select(*key, F.concat(folder, F.lit("/"), F.col("specifier")).alias("base"), F.lit(0).alias("nth"))
    rest = F.expr("substring(specifier, 3)")
    rooted = asked.where("specifier like '@/%' or specifier like '~/%'").select(
        *key, F.posexplode(F.array(rest, F.concat(F.lit("src/"), rest))).alias("nth", "base")
    )
    found = near.unionByName(rooted.select(*key, "base", (F.col("nth") + 1_000_000).alias("nth")))
    if aliases is None:
        return found
    hit = F.when(F.col("exact"), F.col("specifier") == F.col("prefix")).otherwise(F.col("specifier").startswith(F.col("prefix")))
    tail = F.expr("substring(specifier, length(prefix) + 1)")
    mapped = asked.where("specifier not like '.%'").join(aliases, "project").where(hit)
    return found.unionByName(mapped.select(*key, F.replace(F.col("target"), F.lit("*"), tail).alias("base"), F.col("rule").alias("nth")))


def resolved_imports(files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(project, src, dst): imports joined with the first existing candidate file of the same project.

    Relative specifiers, ``@/`` and ``~/``, and the path aliases of ``alias_rules``.
    """
    asked = import_specifiers(files).select("project", "file", "specifier").distinct()
    based = _bases(asked, aliases).withColumn("base", normalized_path(F.col("base")))
    bare = F.regexp_replace("base", r"\.(js|jsx|mjs|cjs)$", "")
    tails = [".ts", ".tsx", ".mts", ".cts", ".d.ts", "/index.ts", "/index.tsx", "/index.mts", "/index.cts"]
    candidates = F.array(F.col("base"), bare, *[F.concat(bare, F.lit(t)) for t in tails])
    each = based.select("project", "file", "specifier", "nth", F.posexplode(candidates).alias("ord", "candidate"))
    known = files.where("text is not null").select("project", F.col("relative").alias("candidate")).distinct()
    first = each.join(known, ["project", "candidate"]).groupBy("project", "file", "specifier").agg(F.min_by("candidate", F.struct("nth", "ord")).alias("dst"))
    return first.select("project", F.col("file").alias("src"), "dst").where("src <> dst").distinct()


def call_edges(files: DataFrame, found: DataFrame) -> DataFrame:
    """(project, src, dst): a file calls a name that another file of the project declares."""
    declared = found.select("project", F.col("symbol").alias("name"), F.col("file").alias("dst")).distinct()
    called = callees(files).select("project", "name", F.col("file").alias("src")).distinct()
    return called.join(declared, ["project", "name"]).where("src <> dst").select("project", "src", "dst").distinct()


def edges(files: DataFrame, found: DataFrame) -> DataFrame:
    """(project, src, dst, kind): imports count in both directions, calls in one."""
    imports = resolved_imports(files)
    back = imports.select("project", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("imported_by").alias("kind"))
    calls = call_edges(files, found).withColumn("kind", F.lit("call"))
    return imports.withColumn("kind", F.lit("import")).unionByName(back).unionByName(calls)


def snapshot(files: DataFrame) -> DataFrame:
    """(project, snapshot): a hash of all paths and content hashes of a project.

    Hashed in two levels, so that no list holds a whole project: the sorted entries of each of 4096
    buckets, then the sorted bucket hashes.
    """
    entry = F.concat("relative", F.lit(":"), F.sha2("text", 256))
    listed = files.where("text is not null").select("project", entry.alias("entry")).distinct()
    bucketed = listed.withColumn("bucket", F.substring(F.sha2("entry", 256), 1, 3))

    def hashed(column: str):
        return F.sha2(F.array_join(F.array_sort(F.collect_list(column)), "\n"), 256)

    inner = bucketed.groupBy("project", "bucket").agg(hashed("entry").alias("part"))
    return inner.groupBy("project").agg(hashed("part").alias("snapshot"))

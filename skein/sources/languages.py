"""Languages, their file extensions, and which files belong to which."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions by language, in registration order. '.v' is never detected by itself.
EXTENSIONS: dict[str, tuple[str, ...]] = {
    "python": (".py",),
    "r": (".r",),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "php": (".php", ".phtml"),
    "perl": (".pl", ".pm"),
    "ruby": (".rb",),
    "lua": (".lua",),
    "c": (".c",),
    "bash": (".sh", ".bash"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"),
    "c_sharp": (".cs",),
    "powershell": (".ps1", ".psm1"),
    "java": (".java",),
    "vb": (".vb",),
    "go": (".go",),
    "rust": (".rs",),
    "zig": (".zig",),
    "solidity": (".sol",),
    "aiken": (".ak",),
    "cairo": (".cairo",),
    "circom": (".circom",),
    "haskell": (".hs",),
    "lean": (".lean",),
    "julia": (".jl",),
    "erlang": (".erl",),
    "masm": (".masm",),
    "swift": (".swift",),
    "objc": (".m", ".mm"),
    "kotlin": (".kt", ".kts"),
    "dart": (".dart",),
    "move": (".move",),
    "tact": (".tact",),
    "func": (".fc", ".func"),
    "sway": (".sw",),
    "rego": (".rego",),
    "proto": (".proto",),
    "thrift": (".thrift",),
    "graphql": (".graphql", ".gql", ".graphqls"),
    "sql": (".sql",),
    "dafny": (".dfy",),
    "fstar": (".fst", ".fsti"),
    "rocq": (".v",),
    "whyml": (".mlw", ".why"),
    "tlaplus": (".tla",),
    "tamarin": (".spthy",),
    "proverif": (".pv", ".pvl"),
}
#: Headers belong to the first of these that the tree has.
HEADER_OWNERS = ("objc", "cpp", "c")


def supported_languages() -> tuple[str, ...]:
    return tuple(EXTENSIONS)


def extension_table(spark: SparkSession) -> DataFrame:
    """(language, extension, priority): a dimension of fixed size."""
    rows = [(lang, ext, k) for k, (lang, exts) in enumerate(EXTENSIONS.items()) for ext in exts if ext != ".v"]
    return spark.createDataFrame(rows, "language string, extension string, priority int")


def owned(files: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """``files`` (path) with the language that owns each; unknown ones go. Headers are C, C++ or Objective-C as the tree is."""
    spark = files.sparkSession
    dims = extension_table(spark)
    if languages is not None:
        if wrong := [x for x in languages if x not in EXTENSIONS]:
            raise ValueError(f"unknown languages: {wrong}")
        extra = [(x, e, k) for k, x in enumerate(languages) for e in EXTENSIONS[x]]
        dims = spark.createDataFrame(extra, "language string, extension string, priority int")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    keyed = files.withColumn("extension", extension)
    direct = keyed.join(F.broadcast(dims), "extension")
    rank = F.array_position(F.array(*[F.lit(x) for x in HEADER_OWNERS]), F.col("language"))
    # Where no file of the family says whose they are, headers go to the first of the languages asked for, or to C.
    known = [x for x in HEADER_OWNERS if languages is None or x in languages]
    family = direct.where(rank > 0).agg(F.coalesce(F.min_by("language", rank), F.lit(None if not known else "c" if languages is None else known[0])).alias("language"))
    headers = keyed.where("extension = '.h'").join(family).where("language is not null").withColumn("priority", F.lit(0))
    return direct.select(*files.columns, "language", "priority").unionByName(headers.select(*files.columns, "language", "priority")).drop("priority")


def detect(files: DataFrame) -> list[str]:
    """The languages present, in registration order."""
    found = {r["language"] for r in owned(files).select("language").distinct().collect()}
    return [x for x in EXTENSIONS if x in found]

"""Text scans: lines that use reflection, and the languages of a source tree."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions of languages, extensions without meaning, and the names that a line of each language is searched for.
EXTENSIONS = {
    "java": [".java"],
    "python": [".py", ".pyi"],
    "ruby": [".rb"],
    "php": [".php", ".phtml"],
    "js": [".js", ".jsx", ".mjs", ".cjs"],
    "ts": [".ts", ".tsx"],
    "go": [".go"],
}
INERT = [".md", ".markdown", ".rst", ".txt", ".adoc", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".bmp", ".pdf", ".csv", ".tsv", ".lock", ".gitignore", ".gitattributes", ".editorconfig", ".dockerignore"]
JAVA_REFLECTION = "invoke getMethod getDeclaredMethod getDeclaredMethods getMethods newInstance getConstructor getDeclaredConstructor getField getDeclaredField setAccessible"
JAVA_PROXIES = "ProxyFactory ProxyFactoryBean getProxy createAopProxy AopProxy ScopedProxyMode @EnableAspectJAutoProxy"
PYTHON_ATTRIBUTES = "getattr setattr delattr hasattr vars globals locals"
PYTHON_CODE = "eval exec compile"
RUBY_SENDS = "public_send __send__ send"
RUBY_HOOKS = "method_missing respond_to_missing?"
RUBY_DEFINITIONS = "define_method instance_eval class_eval module_eval const_get instance_variable_get instance_variable_set"
PHP_CALLS = "call_user_func call_user_func_array ReflectionClass ReflectionMethod forward_static_call forward_static_call_array eval"
GO_REFLECTION = "ValueOf TypeOf New Call MakeFunc Indirect NewAt"


def named(names: str, before: str = r"\b", after: str = r"\b") -> str:
    """An expression for any of the names."""
    return f"{before}(?:{'|'.join(re.escape(n) for n in names.split())}){after}"


def called(names: str, before: str = r"\b") -> str:
    return named(names, before, r"\s*\(")


def either(*expressions: str) -> str:
    return "|".join(expressions)


QUOTES = "'\""


def computed_require(line: Column) -> Column:
    """Whether a line requires something else than one literal: what follows a bracket neither begins with a literal nor closes after it."""
    parts = F.split(line, called("require"))
    literal = either(*(f"{q}[^{q}\\n]*{q}" for q in QUOTES))
    return F.exists(F.slice(parts, F.lit(2), F.size(parts)), lambda a: ~a.rlike(rf"^(?:{literal})\s*\)"))


Pattern = str | Callable[[Column], Column]
_SCRIPT: dict[str, Pattern] = {
    "js-require-dynamic": computed_require,
    "js-function-constructor": called("Function", r"\bnew\s+"),
    "js-eval": called("eval Function"),
}
PATTERNS: dict[str, dict[str, Pattern]] = {
    "java": {
        "java-class-forname": called("forName"),
        "java-method-invoke": called(JAVA_REFLECTION),
        "java-proxy-newproxy": called("newProxyInstance"),
        "java-spring-dynamic-proxy": named(JAVA_PROXIES),
    },
    "python": {
        "python-import-dunder": called("__import__ importlib.import_module"),
        "python-getattr": called(PYTHON_ATTRIBUTES),
        "python-eval-exec": called(PYTHON_CODE),
    },
    "ruby": {
        "ruby-send": either(named(RUBY_SENDS, before=r"\."), called("send")),
        "ruby-method-missing": named(RUBY_HOOKS),
        "ruby-define-method": named(RUBY_DEFINITIONS),
    },
    "php": {
        "php-variable-function": r"\$[A-Za-z_]\w*\s*\(",
        "php-call-user-func": either(called(PHP_CALLS), named("Reflection", r"\bnew\s+", "")),
    },
    "js": _SCRIPT,
    "ts": _SCRIPT,
    "go": {"go-reflect-call": named(GO_REFLECTION, r"\breflect\s*\.\s*")},
}
UNCERTAIN = "structural-uncertainty"
SNIPPET = 200
#: What ends a line.
BREAKS = "\\r\\n|[\\n\\x0B\\f\\r\\x1C-\\x1E\\u0085\\u2028\\u2029]"


def language_of(path: Column) -> Column:
    """Language of a path by its extension, null if that is none's."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for lang, exts in EXTENSIONS.items() for e in exts for x in (e, lang)))
    return table[extension]


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files with a row for each line (line from 1, line_text); a break at the end makes no line."""
    parts = F.split(text, BREAKS, -1)
    kept = F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    out = files.select(*[c for c in files.columns if c != text], F.posexplode(kept).alias("_at", "line_text"))
    return out.select(*[c for c in files.columns if c != text], (F.col("_at") + 1).alias("line"), "line_text")


def _has(pattern: Pattern) -> Column:
    line = F.col("line_text")
    return pattern(line) if callable(pattern) else line.rlike(pattern)


def reflection_sites(files: DataFrame, patterns: dict[str, dict[str, Pattern]] = PATTERNS) -> DataFrame:
    """(file, line, kind, snippet): one site for each line and kind that matches. files: file, language, text.

    A file without a language that is searched is one site of structural uncertainty at line 0, unless its
    extension is inert.
    """
    known = [*patterns]
    searched = files.where(F.col("language").isin(*known)).select("file", "language", "text")
    by_language = {lang: F.array_compact(F.array(*(F.when(_has(p), F.lit(k)) for k, p in kinds.items()))) for lang, kinds in patterns.items()}
    kinds = reduce(lambda rest, item: F.when(F.col("language") == item[0], item[1]).otherwise(rest), by_language.items(), F.array().cast("array<string>"))
    found = lines(searched).select("file", "line", F.explode(kinds).alias("kind"), F.substring(F.trim("line_text"), 1, SNIPPET).alias("snippet"))
    inert = F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1)).isin(*INERT)
    unknown = files.where((F.col("language").isNull() | ~F.col("language").isin(*known)) & ~inert)
    return found.unionByName(unknown.select("file", F.lit(0).alias("line"), F.lit(UNCERTAIN).alias("kind"), F.lit("").alias("snippet")))


def verdicts(sites: DataFrame, trees: DataFrame, by: str) -> DataFrame:
    """(by, verdict, confidence): degraded where a tree has a site, uncertain where it has one of structural uncertainty."""
    s = sites.groupBy(by).agg(F.count("*").alias("sites"), F.bool_or(F.col("kind") == UNCERTAIN).alias("unsure"))
    rows = trees.select(by).distinct().join(s, by, "left")
    return rows.select(by, F.when(F.col("sites") > 0, "degraded").otherwise("closed-world").alias("verdict"), F.when(F.col("unsure"), "uncertain").otherwise("high").alias("confidence"))


def routing_rate(verdicts_: DataFrame) -> DataFrame:
    """Share of trees that aren't closed-world; 0 without any."""
    return verdicts_.agg(F.coalesce(F.avg((F.col("verdict") != "closed-world").cast("double")), F.lit(0.0)).alias("rate"))


def language_mix(files: DataFrame, by: str, language: str = "language") -> DataFrame:
    """(by, primary, mix): counts of languages, and the one with most files (of equals the last by name)."""
    n = files.where(F.col(language).isNotNull()).groupBy(by, language).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.max_by(language, F.struct("n", language)).alias("primary"), F.sort_array(F.collect_list(F.struct(language, "n"))).alias("mix"))


def symbol_index(nodes: DataFrame, name: str, node: str) -> DataFrame:
    """Each name's nodes in order."""
    return nodes.groupBy(name).agg(F.sort_array(F.collect_list(node)).alias("nodes"))

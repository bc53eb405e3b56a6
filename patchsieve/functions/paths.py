"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: language order of the encoded feature
LANGUAGES = [
    "python", "javascript", "typescript", "java", "go", "rust", "c", "cpp", "ruby", "php",
    "swift", "kotlin", "scala", "sql", "shell", "yaml", "json", "toml", "xml", "html", "css",
    "markdown", "text", "unknown",
]

# fixed values: the language of each file extension
LANGUAGE_OF = {
    "py": "python",
    "pyw": "python",
    "js": "javascript",
    "mjs": "javascript",
    "cjs": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "mts": "typescript",
    "cts": "typescript",
    "java": "java",
    "go": "go",
    "rs": "rust",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cxx": "cpp",
    "cc": "cpp",
    "hpp": "cpp",
    "hh": "cpp",
    "rb": "ruby",
    "rake": "ruby",
    "gemspec": "ruby",
    "php": "php",
    "swift": "swift",
    "kt": "kotlin",
    "kts": "kotlin",
    "scala": "scala",
    "sc": "scala",
    "sql": "sql",
    "sh": "shell",
    "bash": "shell",
    "zsh": "shell",
    "yaml": "yaml",
    "yml": "yaml",
    "json": "json",
    "toml": "toml",
    "xml": "xml",
    "html": "html",
    "htm": "html",
    "css": "css",
    "scss": "css",
    "less": "css",
    "md": "markdown",
    "markdown": "markdown",
    "rst": "markdown",
    "txt": "text",
}

# fixed values: test directories (searched anywhere) and test file names (matched at the start)
TEST_DIRECTORY = r"(^|/)(tests?|test_|_test|spec)/"
TEST_NAME = r"(?U)^(test_\w+|\w+_test\.\w+$|\w+_spec\.\w+$|\w+\.test\.\w+$|\w+\.spec\.\w+$)"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last extension in lower case without its dot; leading dots of the name do not count."""
    name = F.regexp_replace(basename(path), r"^\.+", "")
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def stem(path: Column) -> Column:
    """Name without its last extension."""
    name = basename(path)
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+$", "")


def language(path: Column) -> Column:
    pairs = [F.lit(v) for pair in LANGUAGE_OF.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension(path)), F.lit("unknown"))


def language_index(name: Column) -> Column:
    """Place of a language name in the list, scaled to 0 .. 1."""
    known = F.array(*map(F.lit, LANGUAGES))
    place = F.array_position(known, name)
    return F.when(place > 0, place - 1).otherwise(len(LANGUAGES) - 1) / F.lit(float(len(LANGUAGES) - 1))


def language_name(index: Column) -> Column:
    """Inverse of ``language_index``, clamped to the list."""
    top = len(LANGUAGES) - 1
    place = F.greatest(F.lit(0), F.least(F.lit(top), F.floor(index * top + 0.5)))
    return F.element_at(F.array(*map(F.lit, LANGUAGES)), (place + 1).cast("int"))


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_DIRECTORY) | basename(path).rlike(TEST_NAME)


def is_prod_file(path: Column) -> Column:
    return ~is_test_file(path)

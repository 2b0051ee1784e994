"""Path, version and pattern functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and the language that each stands for.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript",
    ".css": "css", ".scss": "scss", ".less": "less", ".html": "html", ".htm": "html", ".json": "json",
    ".yaml": "yaml", ".yml": "yaml", ".md": "markdown", ".rst": "rst", ".txt": "text", ".go": "go", ".rs": "rust",
    ".java": "java", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
    ".swift": "swift", ".kt": "kotlin", ".sql": "sql", ".sh": "shell", ".bash": "shell", ".vue": "vue",
    ".svelte": "svelte", ".toml": "toml", ".ini": "ini", ".cfg": "config", ".xml": "xml", ".svg": "svg",
}
# What makes a file a test, a document, a configuration or an asset in the file catalogue.
TEST_MARKS = ["test_", "_test.", ".test.", ".spec.", "tests/", "__tests__/"]
DOCUMENT_EXTENSIONS = [".md", ".rst", ".txt"]
CONFIG_NAMES = [
    "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "package.json", "tsconfig.json", "vite.config.ts",
    "vite.config.js", "webpack.config.js", "babel.config.js", ".eslintrc.js", ".prettierrc", "Dockerfile",
    "docker-compose.yml", "docker-compose.yaml", ".gitignore", ".env", "Makefile", "CMakeLists.txt", "manifest.json",
    "background.js", "content.js",
]
ASSET_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot"]
# What makes a changed file a manifest, test, document, configuration or source.
CHANGE_MANIFESTS = [
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "pyproject.toml", "setup.py", "setup.cfg",
    "requirements.txt", "pipfile", "pipfile.lock", "poetry.lock", "go.mod", "go.sum", "cargo.toml", "cargo.lock",
    "gemfile", "gemfile.lock", "build.gradle", "pom.xml",
]
CHANGE_TESTS = ["test_", "_test.", "/test/", "/tests/", "spec.", ".spec."]
CHANGE_DOCUMENTS = [".md", ".rst", ".txt", ".adoc"]
CHANGE_CONFIG_EXTENSIONS = [".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env"]
CHANGE_CONFIG_NAMES = [".gitignore", ".gitattributes", ".editorconfig", "makefile", "dockerfile", "docker-compose.yml", ".dockerignore"]
CHANGE_SOURCES = [".py", ".js", ".ts", ".jsx", ".tsx", ".go", ".java", ".rs", ".cpp", ".c", ".cs", ".rb", ".php"]
# Directories that hold others and give no group of their own.
CONTAINERS = ["src", "app", "lib", "pkg", "internal"]


def name(path: Column) -> Column:
    """The part of a path after its last slash."""
    return F.regexp_extract(path, "([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The extension of a path's name with its dot; empty where the only dot is the first character."""
    return F.regexp_extract(name(path), r"[^.]+.*?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """A path's name without its extension."""
    return F.regexp_replace(name(path), r"(?<=[^.])\.[^.]+$", "")


def parent(path: Column) -> Column:
    """The directory of a path, empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def any_in(text: Column, marks: list[str]) -> Column:
    """Whether a text contains one of the marks."""
    return reduce(Column.__or__, [text.contains(m) for m in marks])


def language(path: Column) -> Column:
    """PRJ-01: the language of a path by its extension in lower case, or unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(suffix(path))), F.lit("unknown"))


def file_kind(path: Column) -> Column:
    """PRJ-02: test, document, config, asset, source or other; the first that holds."""
    end = F.lower(suffix(path))
    return (
        F.when(any_in(path, TEST_MARKS), "test").when(end.isin(DOCUMENT_EXTENSIONS), "document")
        .when(name(path).isin(CONFIG_NAMES), "config").when(end.isin(ASSET_EXTENSIONS), "asset")
        .when(end.isin(list(LANGUAGES)), "source").otherwise("other")
    )


def change_category(path: Column, dotfiles: bool = False) -> Column:
    """PRJ-03: manifest, test, doc, config, source or other. Names are compared in lower case on both sides; with
    dotfiles, a name that is itself an extension of configurations counts as one."""
    own, end = F.lower(name(path)), suffix(path)
    config = own.isin(CHANGE_CONFIG_NAMES) | end.isin(CHANGE_CONFIG_EXTENSIONS)
    if dotfiles:
        config = config | own.isin(CHANGE_CONFIG_EXTENSIONS)
    return (
        F.when(own.isin(CHANGE_MANIFESTS), "manifest").when(any_in(F.lower(path), CHANGE_TESTS), "test")
        .when(end.isin(CHANGE_DOCUMENTS), "doc").when(config, "config").when(end.isin(CHANGE_SOURCES), "source").otherwise("other")
    )


def is_schema(path: Column) -> Column:
    """PRJ-04: whether a path is that of a data model, an SQL file or a migration."""
    return name(path).isin("models.py", "schema.py") | name(path).endswith(".sql") | path.rlike(r"(^|/)(migrations|migration|alembic)/")


def group_key(path: Column, containers: list[str] = CONTAINERS) -> Column:
    """PRJ-05: the first directory of a path, or what follows it where that is a container; a path without one is its own."""
    parts = F.split(path, "/")
    return F.when((F.size(parts) > 1) & parts[0].isin(containers), F.get(parts, F.lit(1))).otherwise(parts[0])


def top_dir(path: Column) -> Column:
    """PRJ-05: the first directory of a path; empty for a path without one."""
    return F.when(path.contains("/"), F.split(path, "/")[0]).otherwise("")


def glob_regex(glob: str) -> str:
    """PRJ-06: a shell pattern as an anchored regular expression; * and ? match a slash too."""
    out, i = "", 0
    while i < len(glob):
        ch, end = glob[i], glob.find("]", i + 2)
        i += 1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and end > 0:
            body = glob[i:end].replace("\\", r"\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body.replace("^", r"\^", 1) if body[0] == "^" else body) + "]"
            i = end + 1
        else:
            out += ch if ch.isalnum() or ch in "_/-" else "\\" + ch
    return f"(?s)^{out}$"


def matches(path: Column, pattern: str) -> Column:
    """Whether a pattern matches a path, is a directory of it, or matches its name."""
    regex = glob_regex(pattern)
    found = path.rlike(regex) | name(path).rlike(regex)
    return found | path.startswith(pattern) if pattern.endswith("/") else found


def match_any(path: Column, patterns: list[str]) -> Column:
    """PRJ-06: whether one of the patterns matches."""
    return reduce(Column.__or__, [matches(path, p) for p in patterns], F.lit(False))


def first_match(path: Column, patterns: list[str]) -> Column:
    """PRJ-06: the first pattern that matches, null for none."""
    return F.coalesce(*[F.when(matches(path, p), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


def covers(wide: Column, narrow: Column) -> Column:
    """PRJ-07: whether one pattern covers another: the same, everything, a directory of it, or a glob over a plain path."""
    whole = wide.isin("*", "**", "**/*")
    below = wide.endswith("/**") & narrow.startswith(F.regexp_replace(wide, r"\*\*$", ""))
    plain = ~narrow.rlike(r"[*?\[\]]") & F.regexp_like(narrow, F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(wide, r"([.+^$(){}|\\])", r"\\$1"), r"\*+", ".*"), F.lit("$")))
    return (wide == narrow) | whole | below | plain


def safe_id(value: Column) -> Column:
    """PRJ-10: whether a value is a plain identifier: letters, digits, dot, dash and underscore, and no dots alone."""
    return value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~value.contains("..")


def bumped(version: Column, bump: Column) -> Column:
    """RUL-25: a version with its major, minor or patch part raised and the parts after it zero; a v stays, and what is no
    version of three numbers is returned as it is."""
    parts = F.split(F.regexp_replace(version, "^v+", ""), r"\.")
    major, minor, patch = (F.try_to_number(F.get(parts, F.lit(k)), F.lit("999999999")).cast("long") for k in range(3))
    v = F.when(version.startswith("v"), "v").otherwise("")
    dot = F.lit(".")
    made = (
        F.when(bump == "major", F.concat(v, major + 1, F.lit(".0.0")))
        .when(bump == "minor", F.concat(v, major, dot, minor + 1, F.lit(".0")))
        .when(bump == "patch", F.concat(v, major, dot, minor, dot, patch + 1))
    )
    return F.coalesce(F.when(F.size(parts) >= 3, made), version)


# Directories and extensions that no patch may touch.
UNPATCHED_DIRS = [
    ".git", "node_modules", "dist", "build", "venv", ".venv", "__pycache__", ".pytest_cache", ".mypy_cache", "target", "vendor",
]
UNPATCHED_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pdf", ".zip",
    ".gz", ".tar", ".so", ".dylib", ".dll", ".pyc", ".pyo", ".bin", ".exe", ".o", ".a", ".lib", ".mp3", ".mp4", ".mov",
    ".wav", ".sqlite", ".db",
]


def unsafe(path: Column) -> Column:
    """PRJ-09: why a path may not be patched: skipped_dir, traversal, escape or binary; null if it may. Links are a matter of
    the file system and not of the path."""
    parts = F.split(path, "/")
    return (
        F.when(F.arrays_overlap(parts, F.array(*map(F.lit, UNPATCHED_DIRS))), "skipped_dir").when(F.array_contains(parts, ".."), "traversal")
        .when(path.startswith("/"), "escape").when(F.lower(suffix(path)).isin(UNPATCHED_EXTENSIONS), "binary")
    )


# Extensions of code that is reviewed and of pages, names of files of the environment, and marks of tests.
REVIEWED_EXTENSIONS = [".py", ".pyw", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".mts", ".cts"]
PAGE_EXTENSIONS = [".html", ".htm", ".vue", ".svelte"]
ENVIRONMENT_NAMES = [".env", ".env.local", ".env.production", ".env.development"]
REVIEW_TEST_MARKS = ["test_", "_test", "/test/", "/tests/", "spec.", ".spec.", "_test.py", "_test.js", "_test.ts"]


def is_reviewed(path: Column) -> Column:
    """PRJ-04: whether a file is code that the security rules are for."""
    return suffix(path).isin(REVIEWED_EXTENSIONS)


def is_page(path: Column) -> Column:
    """PRJ-04: whether a file is a page or a template."""
    return suffix(path).isin(PAGE_EXTENSIONS)


def is_environment(path: Column) -> Column:
    """PRJ-04: whether a file holds settings of the environment."""
    return name(path).isin(ENVIRONMENT_NAMES)


def is_test(path: Column) -> Column:
    """PRJ-04: whether a path has a mark of tests, in any case."""
    return any_in(F.lower(path), REVIEW_TEST_MARKS)

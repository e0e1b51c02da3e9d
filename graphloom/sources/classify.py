"""Classification of files by path and content (SRC-4/5/6, FLT-12) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.scalar import base_name, col, folder, suffix

#: Fixed values of the classification.
ALWAYS_IGNORE = (".git", "__pycache__", ".venv", "node_modules", ".pytest_cache", ".mypy_cache")
TEST_NAMES, TEST_DIRS = ("test_", "_test.", ".test.", ".spec."), ("test", "tests", "__tests__", "spec")
DOC_SUFFIXES, DOC_DIRS = (".md", ".rst", ".txt", ".adoc"), ("docs", "doc")
DOC_NAMES = ("readme", "changelog", "license", "contributing", "authors", "notice")
CONFIG_SUFFIXES = (".toml", ".yaml", ".yml", ".json", ".ini", ".cfg", ".env")
CONFIG_NAMES = (
    "dockerfile", "makefile", ".gitignore", ".dockerignore", ".editorconfig", "pyproject.toml", "package.json", "package-lock.json", "poetry.lock",
    "requirements.txt", "setup.py", "setup.cfg", "uv.lock",
)
VENDOR_DIRS = ("vendor", "vendors", "third_party", "third-party", "thirdparty", "bower_components", "site-packages")
GENERATED_NAMES = (".min.", "-min.", ".bundle.", ".generated.", "_pb2.py", "_pb2_grpc.py", ".pb.go", ".g.dart")
SOURCE_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java", ".c", ".h", ".cpp", ".hpp", ".rb", ".php", ".cs", ".swift", ".kt", ".scala", ".sh")
BANNER = r"@generated|do not edit|code generated by|auto-?generated (?:by|using|with)\b"
BANNER_BYTES, MINIFIED_BYTES, MINIFIED_LINE = 1024, 1500, 200
SECRET_DIRS, SECRET_SUFFIXES = (".ssh", ".aws", ".azure", ".gnupg", "secrets"), (".pem", ".key", ".p12", ".pfx", ".keystore")
SECRET_NAMES = ("credentials", "credentials.json", "secrets.json", "id_rsa", "id_ed25519")
MOST_TEXT_BYTES = 1 << 20


def _any(names: tuple[str, ...], c: Column) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.contains(c, F.lit(n))
    return out


def _folders(path: Column) -> Column:
    return F.split(F.lower(folder(path)), "/")


def _within(path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(_folders(path), F.array(*[F.lit(n) for n in names]))


def kind_of(path: str | Column) -> Column:
    """vendor, generated, test, config, doc, source or other; the first that fits."""
    path = col(path)
    name, ext = F.lower(base_name(path)), suffix(path)
    source = ext.isin(*SOURCE_SUFFIXES)
    return (
        F.when(source & _within(path, VENDOR_DIRS), "vendor")
        .when(source & _any(GENERATED_NAMES, name), "generated")
        .when(_within(path, TEST_DIRS) | _any(TEST_NAMES, name), "test")
        .when(ext.isin(*CONFIG_SUFFIXES) | name.isin(*CONFIG_NAMES), "config")
        .when(ext.isin(*DOC_SUFFIXES) | F.substring_index(name, ".", 1).isin(*DOC_NAMES) | _within(path, DOC_DIRS), "doc")
        .when(source, "source")
        .otherwise("other")
    )


def looks_generated(content: Column) -> Column:
    """A generator's banner at the start, or very long lines on average."""
    head = F.lower(F.try_validate_utf8(F.substring(content, 1, BANNER_BYTES).cast("string")))
    head = F.coalesce(head, F.lower(F.decode(F.substring(content, 1, BANNER_BYTES), "ISO-8859-1")))
    size = F.octet_length(content)
    text = F.decode(content, "ISO-8859-1")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return head.rlike(BANNER) | ((size >= MINIFIED_BYTES) & (size / lines > MINIFIED_LINE))


def secret_path(path: str | Column) -> Column:
    """Paths that are never evidence; a list of names, not a detector."""
    path = col(path)
    name = F.lower(base_name(path))
    parts = F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(n) for n in SECRET_DIRS]))
    return parts | name.startswith(".env") | suffix(path).isin(*SECRET_SUFFIXES) | name.isin(*SECRET_NAMES)


def omission(path: str | Column, content: Column) -> Column:
    """Why a file is no text evidence, or null (SRC-6)."""
    path = col(path)
    return (
        F.when(path.startswith("/") | F.array_contains(F.split(path, "/"), "..") | secret_path(path), "excluded path")
        .when(F.octet_length(content) > MOST_TEXT_BYTES, "larger than 1 MiB")
        .when(F.instr(F.decode(content, "ISO-8859-1"), "\x00") > 0, "binary")
        .when(~F.is_valid_utf8(content.cast("string")), "not UTF-8")
    )

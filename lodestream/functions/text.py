"""String functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display ranges, colour bounds, project markers, labels and path patterns.
WIDE = "[\\u1100-\\u115f\\u2e80-\\ua4cf\\uac00-\\ud7a3\\uf900-\\ufaff\\ufe30-\\ufe6f\\uff00-\\uff60\\uffe0-\\uffe6]|[\\x{1f300}-\\x{1faff}]"
NARROW = "[\\u0300-\\u036f\\u200b-\\u200d\\ufe0f]"
WARN, DANGER = 50, 80
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def lines(c: Column) -> Column:
    """Lines as splitlines() gives them: no empty line after a final break."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def nonempty_lines(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n", -1), lambda x: x.rlike("(?U)\\S")))


def first_line(c: Column) -> Column:
    """The first line with text, without its heading or list mark and without double stars, double lines and backticks."""
    line = F.try_element_at(F.filter(F.split(c, "\n", -1), lambda x: x.rlike("(?U)\\S")), F.lit(1))
    bare = F.regexp_replace(line, "(?U)^\\s*(?:#+|[-*]|[0-9]+\\.)\\s+", "")
    return F.coalesce(F.regexp_replace(F.regexp_replace(bare, "\\*\\*|__|`", ""), "(?U)^\\s+|\\s+$", ""), F.lit(""))


def display_width(c: Column) -> Column:
    wide, none = (F.length(F.regexp_replace(c, p, "")) for p in (WIDE, NARROW))
    n = F.length(c)
    return n + (n - wide) - (n - none)


def pad_right(c: Column, columns: int) -> Column:
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(columns) - display_width(c), F.lit(0))))


def pad_centre(c: Column, columns: int) -> Column:
    """A label in the middle of so many columns, filled with spaces that do not break; a longer one stays."""
    spare = F.greatest(F.lit(columns) - F.length(c), F.lit(0))
    left = F.floor(spare / 2).cast("int")
    return F.concat(F.repeat(F.lit("\u00a0"), left), c, F.repeat(F.lit("\u00a0"), spare - left))


def basename(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(c, "[\\\\/]", -1), lambda x: x != ""), F.lit(-1)), F.lit("/"))


def model_label(c: Column, vendor: str = "vendor") -> Column:
    """A model id without its vendor, bracket and date; the numbers at its end become a version. The patterns are fixed values."""
    for pattern, new in ((f"^{vendor}-", ""), ("\\[[^\\[\\]]*\\]$", ""), ("-[0-9]{8}$", ""), ("-([0-9]+)-([0-9]+)$", "$1.$2"), ("-([0-9]+)$", "$1")):
        c = F.regexp_replace(c, pattern, new)
    return c


def tool_version(tool: Column, printed: Column) -> Column:
    """The version out of what a tool prints; each tool has its own form (fixed values), and a text of another form gives none."""
    trimmed = F.regexp_replace(printed, "^\\s+|\\s+$", "")
    second = F.coalesce(F.try_element_at(F.split(trimmed, "\\s+"), F.lit(2)), F.lit(""))
    first_line = F.regexp_replace(F.element_at(F.split(printed, "\n"), 1), "^(?:Terraform|OpenTofu) ", "")
    return (
        F.when(tool == "node", F.regexp_replace(trimmed, "^v", "")).when(tool.isin("python", "rust"), second).when(tool == "go", F.regexp_extract(trimmed, "^go version go(\\S+)", 1))
        .when(tool == "bun", trimmed).when(tool == "terraform", F.regexp_replace(F.trim(first_line), "^v", ""))
    )


# Files, folders (with a slash) and endings that show a kind of project, and those that rule it out.
PROJECTS = {
    "node": (("package.json", ".node-version", ".nvmrc", "node_modules/"), ("js", "mjs", "cjs", "ts", "mts", "cts"), ("bunfig.toml", "bun.lock", "bun.lockb", "deno.json", "deno.jsonc", "deno.lock", "esy.lock/")),
    "python": (("requirements.txt", ".python-version", "pyproject.toml", "Pipfile", "tox.ini", "setup.py", "__init__.py"), ("py", "ipynb"), ()),
    "rust": (("Cargo.toml",), ("rs",), ()),
    "go": (("go.mod", "go.sum", "go.work", "glide.yaml", "Gopkg.yml", "Gopkg.lock", ".go-version", "Godeps/"), ("go",), ()),
    "bun": (("bun.lock", "bun.lockb", "bunfig.toml"), (), ()),
    "terraform": ((".terraform/",), ("tf", "tofu", "tfplan", "tfstate"), ()),
}


def project(kind: str, entries: Column, virtual_env: Column) -> Column:
    """Whether a folder's entries (folders end with a slash) show that kind; for Python a set variable does, too."""
    names, ends, never = PROJECTS[kind]
    named = lambda own: F.arrays_overlap(entries, F.array(*map(F.lit, own))) if own else F.lit(False)
    ended = F.exists(entries, lambda e: e.rlike(rf"\.(?:{'|'.join(ends)})$")) if ends else F.lit(False)
    found = (named(names) | ended) & ~named(never)
    return found | virtual_env.isNotNull() if kind == "python" else found


def level(c: Column) -> Column:
    """The colour of the unrounded value."""
    return F.when(c >= DANGER, "danger").when(c >= WARN, "warn").otherwise("normal")


def rounded(c: Column) -> Column:
    """Half toward plus infinity."""
    return F.floor(c + 0.5)


def git_status(code: Column, out: Column) -> Column:
    """What a status of lines and branch headers says: commits to push stand before changes; a first commit or a detached head has nothing to push."""
    header = lambda key: F.coalesce(branch_header(out, key), F.lit(""))
    nothing = (header("oid") == "(initial)") | (header("head") == "(detached)")
    unpushed = ~nothing & (branch_header(out, "upstream").isNull() | header("ab").rlike("^\\+[1-9]"))
    return F.when(code != 0, "no-git").when(unpushed, "unpushed").when(out.rlike("(?m)^[^#\n]"), "uncommitted").otherwise("clean")


def branch_header(out: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(out, f"(?m)^# branch\\.{key} (.*)$", 1), F.lit(""))


def branch_name(code: Column, out: Column) -> Column:
    """The branch; empty without git and on a detached head."""
    head = F.coalesce(branch_header(out, "head"), F.lit(""))
    return F.when((code != 0) | (head == "(detached)"), "").otherwise(head)


def issue_number(branch: Column) -> Column:
    return F.nullif(F.regexp_extract(branch, "(?:^|/)([0-9]+)$", 1), F.lit(""))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), "\\.md$", "")


def int_or(c: Column, default: int, least: int = 1) -> Column:
    """The leading integer of a text if it is at least `least`, else the default."""
    n = F.regexp_extract(c, "^\\s*([+-]?[0-9]+)", 1).try_cast("long")
    return F.when(n >= least, n).otherwise(F.lit(default).cast("long"))


def robots_url(url: Column) -> Column:
    return F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("AUTHORITY")), F.lit("/robots.txt"))


def robots_gate(status: Column) -> Column:
    return F.when(status.isin(401, 403), "deny").when((status >= 400) & (status < 500), "allow").otherwise("parse")


def looks_html(html: Column, content_type: Column) -> Column:
    return F.contains(F.substring(html, 1, 100), F.lit("<html")) | F.coalesce(F.contains(content_type, F.lit("text/html")), F.lit(True)) | (content_type == "")


def size_guard(text: Column, most: int = 200_000, force: bool = False) -> Column:
    return F.when((F.length(text) > most) & ~F.lit(force), "error").otherwise("ok")


# Classes of paths that may hold secrets, with the patterns of each, in their order; * is any text without a slash.
SECRETS = {
    "env": (".env*", ".envrc", ".dev.vars"),
    "key": ("*.pem", "*.key", "*.p12", "*.pfx", "*.jks", "*.keystore", "id_rsa", "id_ecdsa", "id_ed25519"),
    "credentials": ("credentials", "credentials.json", "client_secret*.json", "service-account*.json", "*secret*.json", "secrets.yml", "secrets.yaml"),
    "tool": (".npmrc", ".pypirc", ".netrc", ".pgpass", ".my.cnf", ".aws/credentials", ".ssh/**"),
    "infra": ("*.tfvars", "*.tfstate", "*.tfstate.backup"),
}
#: Samples and public keys.
NO_SECRETS = ("*.example", "*.sample", "*.template", "*.pub")


def path_pattern(*patterns: str) -> str:
    """One regular expression for paths whose end fits a pattern; ** is all below a folder."""
    own = [re.escape(p).replace(r"\*\*", ".+").replace(r"\*", "[^/]*") for p in patterns]
    return f"(?i)(?:^|/)(?:{'|'.join(own)})$"


def secret_path(path: Column) -> Column:
    """The class of a path that may hold secrets, or null; samples and public keys are exempt."""
    out = F.when(path.rlike(path_pattern(*NO_SECRETS)), F.lit(None))
    for kind, patterns in SECRETS.items():
        out = out.when(path.rlike(path_pattern(*patterns)), kind)
    return out


def jst_window(day: Column) -> tuple[Column, Column]:
    """The UTC epoch seconds of a Japanese calendar day, null for an invalid date."""
    start = F.unix_timestamp(F.to_utc_timestamp(F.expr("try_to_timestamp(d, 'yyyy-MM-dd')") if day is None else F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), "Asia/Tokyo"))
    return start, start + 86400


def jst_clock(iso: Column) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.try_to_timestamp(iso), "Asia/Tokyo"), "HH:mm"), iso)

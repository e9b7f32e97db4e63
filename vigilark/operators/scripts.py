"""Calls and sums in scripts by bracket matching: tokens as rows, depths and extents as windows over them.

A file becomes tokens (literals, templates and comments whole). Running depths by kind of bracket tell where an
opening one closes; the tokens of one depth, with each bracket's inside left out, make lists in which operands and
operators follow each other. There a call is an opening parenthesis after an operand, and an operator's expression
reaches from the nearest weaker operator before it to the nearest one as weak after it, over as many lines as it takes.
What a template substitutes is read as a piece of its own, so calls inside it are found, in templates inside it too.

Files are at most MAX_FILE_BYTES long, so the windows, one file each, are bounded; files are dealt to as many tasks as their
characters ask for, so that what a task sorts is bounded too. Left as they are: templates nested
more than three deep; a slash is taken for a pattern's by the character before it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import has

SNIPPET = 200
#: Characters of scripts that a task reads on average; their tokens are sorted in memory.
TASK_CHARS = 500_000
# fixed values: words that a script must hold, and those of an SQL text
SCRIPT_TRIGGERS = ("eval(", "exec(", "child_process", ".exec(", "execSync(", "readFile(", "readFileSync(", "path.join(", "SELECT ", "INSERT ", "UPDATE ", "DELETE ")
SQL_VERB = r"\b(SELECT|INSERT|UPDATE|DELETE)\b"
SQL_CLAUSE = r"\b(FROM|INTO|WHERE|VALUES|SET|JOIN)\b"
SQL_TOKENS = ("EXECUTE", "QUERY", "CURSOR", "._Q(", "SQL", "TABLE", "RETURNING")
SCRIPT_SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")

_STRING = r'"(?:[^"\\\n]|\\(?s:.))*+"?|' + r"'(?:[^'\\\n]|\\(?s:.))*+'?"
_COMMENT = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"


def _template(depth: int) -> str:
    """A template, with substitutions that hold templates themselves, so many deep."""
    inside = _substitution(depth - 1) if depth else r"\$\{[^{}`]*+\}"
    return rf"`(?:[^`\\$]|\\(?s:.)|\$(?!\{{)|{inside})*+`"


def _substitution(depth: int) -> str:
    rest = _template(depth) if depth else "`[^`]*+`"
    braces = rf"\{{(?:[^{{}}`\"']|{_STRING}|{rest})*+\}}"
    return rf"\$\{{(?:[^{{}}`\"']|{_STRING}|{rest}|{braces})*+\}}"


_NAME = r"[A-Za-z_$\x{80}-\x{10FFFF}][\w$\x{80}-\x{10FFFF}]*+"
_REGEX = r"(?<=[=(,:;!&|?{}\[\n]\s{0,3})/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
_OPERATOR = r"=>|[=!]==?|<=|>=|\*\*=?|&&=?|\|\|=?|\?\?=?|\?\.(?!\d)|\.\.\.|\+\+|--|<<=?|>>>?=?|[-+*/%&|^]="
TOKEN = "|".join((_COMMENT, _STRING, _template(2), _REGEX, _NAME, r"\d[\w.]*+", r"\s++", _OPERATOR, r"(?s:.)"))
TEMPLATE_PART = rf"{_substitution(2)}|(?:[^\\$]|\\(?s:.)|\$(?!\{{))++|(?s:.)"

PRECEDENCE = (("??",), ("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "instanceof", "in"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",))
PREFIX = ("typeof", "void", "delete", "await", "new", "yield", "async", "!", "~", "...", "++", "--")
STATEMENT = ("return", "throw", "case", "default", "const", "let", "var", "if", "else", "for", "while", "do", "switch", "function", "class", "extends", "import", "export", "from", "try", "catch", "finally", "of", "break", "continue", "debugger", "with")


def tokens(pieces: DataFrame) -> DataFrame:
    """pieces (file_path, piece, base, text) to their tokens (pos, tok) with line, offset and end; white space and comments only move these."""
    x = pieces.select("file_path", "piece", "base", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("pos", "tok"))
    before = W.partitionBy("file_path", "piece").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    lines = F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))
    x = x.withColumn("line", F.col("base") + F.coalesce(F.sum(lines).over(before), F.lit(0))).withColumn("start", F.coalesce(F.sum(F.length("tok")).over(before), F.lit(0)))
    return x.withColumn("end", F.col("start") + F.length("tok")).where(~F.rlike("tok", F.lit(r"^(?:\s|//|/\*)"))).drop("base")


def substituted(found: DataFrame) -> DataFrame:
    """What the templates among tokens substitute, each a piece of its own."""
    t = found.where(F.startswith("tok", F.lit("`")) & F.contains("tok", F.lit("${"))).withColumn("parts", F.regexp_extract_all("tok", F.lit(TEMPLATE_PART), F.lit(0)))
    t = t.select("file_path", "piece", "pos", "line", "parts", F.posexplode("parts").alias("nth", "part")).where(F.startswith("part", F.lit("${")))
    ahead = F.array_join(F.slice("parts", F.lit(1), F.col("nth")), "")
    lines = F.length(ahead) - F.length(F.replace(ahead, F.lit("\n"), F.lit("")))
    return t.select("file_path", F.concat_ws(".", "piece", "pos", "nth").alias("piece"), (F.col("line") + lines).cast("long").alias("base"), F.expr("substr(part, 3, length(part) - 3)").alias("text"))


def matched(found: DataFrame) -> DataFrame:
    """Tokens with `close`, the end of the bracket that one opens, and `depth`, that of the list it is an item of."""
    w = W.partitionBy("file_path", "piece").orderBy("pos")
    kinds = {"(": ")", "[": "]", "{": "}"}
    opens, closes = F.col("tok").isin(*kinds), F.col("tok").isin(*kinds.values())
    step = lambda a, b: F.when(F.col("tok").isin(*a), 1).when(F.col("tok").isin(*b), -1).otherwise(0)
    own = [F.when(F.col("tok").isin(a, b), F.sum(step([a], [b])).over(w) + F.when(F.col("tok") == b, 1).otherwise(0)) for a, b in kinds.items()]
    x = found.withColumn("level", F.coalesce(*own)).withColumn("depth", F.sum(step(kinds, kinds.values())).over(w) - F.when(opens, 1).otherwise(0))
    x = x.withColumn("kind", F.when(opens | closes, F.translate("tok", ")]}", "([{")))
    pair = W.partitionBy("file_path", "piece", "kind", "level").orderBy("pos")
    return x.withColumn("opens", opens).withColumn("closes", closes).withColumn("close", F.when(opens & (F.lead("tok").over(pair) != F.col("tok")), F.lead("end").over(pair))).drop("level", "kind")


def items(x: DataFrame) -> DataFrame:
    """Tokens in lists of one depth, each list after a mark, with what stands around them and the extents of operators."""
    mark = x.where("opens").select("file_path", "piece", "pos", F.lit("").alias("tok"), "line", F.col("end").alias("start"), "end", (F.col("depth") + 1).alias("depth"), F.lit(False).alias("opens"), F.lit(False).alias("closes"), F.lit(None).cast("bigint").alias("close"))
    x = x.unionByName(mark)
    w = W.partitionBy("file_path", "piece", "depth").orderBy("pos")
    tok = F.col("tok")
    named = F.rlike("tok", F.lit(rf"^{_NAME}$"))
    word = named & ~tok.isin(*PREFIX, *STATEMENT, "in", "instanceof")
    literal = F.rlike("tok", F.lit(r"^(?:[\"'`\d]|/.+/[a-z]*$)"))
    x = x.withColumn("prior", F.lag("tok").over(w)).withColumn("dotted", F.coalesce(F.lag("tok").over(w).isin(".", "?."), F.lit(False)))
    x = x.withColumn("word", word | (named & F.col("dotted"))).withColumn("ends", F.col("word") | literal | (F.col("closes") & (tok != "}")) | ((tok == "}") & F.col("closes")))
    x = x.withColumn("after", F.coalesce(F.lag("ends").over(w), F.lit(False)))
    binary = [F.col("after") & tok.isin(*ops) & ~F.col("dotted") for ops in PRECEDENCE]
    strength = F.coalesce(*[F.when(b, k + 1) for k, b in enumerate(binary)], F.lit(0))
    x = x.withColumn("strength", strength)
    # an operand right after another begins a statement of its own; a call, an index or a tagged template goes on
    fresh = F.col("after") & ((F.col("word") & ~F.col("dotted")) | (literal & ~F.startswith("tok", F.lit("`"))) | (tok == "{"))
    weak = (tok == "") | tok.isin(",", ";", ":", "?", "=>") | F.rlike("tok", F.lit(r"^(?:=|[-+*/%&|^]=|\*\*=|&&=|\|\|=|\?\?=|<<=|>>>?=)$")) | (tok.isin(*STATEMENT) & ~F.col("dotted"))
    x = x.withColumn("fresh", fresh).withColumn("weak", weak)
    chain = (F.col("word") & ~F.col("dotted")) | (literal & ~(F.startswith("tok", F.lit("`")) & F.col("after"))) | (F.col("opens") & (~F.col("after") | (tok == "{")))
    to_here = w.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("chain", F.last(F.when(chain, F.struct("start", "line", "pos", F.col("prior").alias("led"))), True).over(to_here))
    next_ = F.lead(F.struct("start", "line")).over(w)
    x = x.withColumn("_next", next_).withColumn("_end", F.lag("end").over(w)).withColumn("then", F.lead("tok").over(w)).withColumn("prior2", F.lag("tok", 2).over(w)).withColumn("touch", F.lag("start").over(w) == F.lag("end", 2).over(w))
    # of a list's brackets the inside is in other lists, so what a closing one ends is known to the opening one alone
    left = lambda k: F.last(F.when(F.col("fresh"), F.struct("start", "line")).when(F.col("weak") | ((F.col("strength") > 0) & (F.col("strength") < k)), F.col("_next")), True).over(w.rowsBetween(W.unboundedPreceding, -1))
    right = lambda k: F.first(F.when(F.col("fresh") | F.col("weak") | ((F.col("strength") > 0) & (F.col("strength") <= k)), F.col("_end")), True).over(w.rowsBetween(1, W.unboundedFollowing))
    whole = F.max("end").over(W.partitionBy("file_path", "piece", "depth"))
    first = F.first(F.struct("start", "line")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    pick = lambda f: F.coalesce(*[F.when(F.col("strength") == k, f(k)) for k in range(1, len(PRECEDENCE) + 1)])
    return x.withColumn("_from", F.when(F.col("strength") > 0, F.coalesce(pick(left), first))).withColumn("_to", F.when(F.col("strength") > 0, F.coalesce(pick(right), whole)))


def looks_like_sql(text: Column) -> Column:
    up = F.upper(text)
    return F.rlike(up, F.lit(SQL_VERB)) & F.rlike(up, F.lit(SQL_CLAUSE)) & F.rlike(up, F.lit("|".join(map(re.escape, SQL_TOKENS))))


def script_findings(files: DataFrame, task_chars: int = TASK_CHARS) -> DataFrame:
    """(file_path, line, kind, snippet) of files (file_path, text): kinds script_eval, script_exec, script_read and script_sql.

    Files are read twice, the first time to count their characters.
    """
    pieces = files.where(F.expr(has("lower(text)", [t.lower() for t in SCRIPT_TRIGGERS]))).select("file_path", F.lit("").alias("piece"), F.lit(1).cast("long").alias("base"), "text")
    # an exchange that adaptive execution or the setting of shuffle partitions sizes would give a task more with more files
    tasks = (pieces.agg(F.sum(F.length("text"))).first()[0] or 0) // task_chars + 1
    spread = lambda x: x.repartition(tasks, "file_path", "piece")
    found, level = [], pieces
    for _ in range(3):
        found.append(tokens(spread(level)))
        level = substituted(found[-1])
        pieces = pieces.unionByName(level)
    every = found[0].unionByName(found[1]).unionByName(found[2])
    x = items(matched(spread(every)))
    callee = F.col("prior")
    call = (F.col("tok") == "(") & F.col("opens") & F.col("after") & ~F.coalesce(F.col("prior2") == "function", F.lit(False))
    bare = callee.isNotNull() & (F.col("chain.pos") == F.col("callee_pos"))
    x = x.withColumn("callee_pos", F.lag("pos").over(W.partitionBy("file_path", "piece", "depth").orderBy("pos"))).withColumn("followed", F.lead("tok", 2).over(W.partitionBy("file_path", "piece", "depth").orderBy("pos")))
    call = call & ~F.coalesce(F.col("followed") == "{", F.lit(False)) & ~(F.coalesce(F.col("chain.led") == "new", F.lit(False)) & bare)
    method = F.col("prior2").isin(".", "?.") & F.col("touch") & (callee == "exec")
    kinds = F.array_compact(F.array(
        F.when(call & bare & callee.isin("eval", "exec"), "script_eval"), F.when(call & ((bare & callee.isin("exec", "execSync")) | method), "script_exec"),
        F.when(call & bare & callee.isin("readFile", "readFileSync"), "script_read"), F.when(F.col("strength") > 0, "script_sql"),
    ))
    at = F.when(F.col("strength") > 0, F.col("_from")).otherwise(F.struct("chain.start", "chain.line"))
    x = x.select("file_path", "piece", F.explode(kinds).alias("kind"), at.alias("at"), F.coalesce("_to", "close").alias("to"))
    text = F.expr("substr(text, CAST(at.start AS INT) + 1, CAST(coalesce(to, length(text)) - at.start AS INT))")
    x = x.join(pieces.select("file_path", "piece", "text"), ["file_path", "piece"]).withColumn("snippet", F.trim(text))
    x = x.where((F.col("kind") != "script_sql") | looks_like_sql(F.col("snippet")))
    return x.select("file_path", F.col("at.line").cast("int").alias("line"), "kind", F.substring("snippet", 1, SNIPPET).alias("snippet"))

r"""Markup residue: constructs of HTML, Markdown, reStructuredText, wiki and LaTeX, per-site templates of them, and clean text.

Three steps over whole texts:

1. Tokens. One pattern finds every construct of a record, in the JVM. Comparison signs, prices, paths, shell pipes, option names,
   footnote numbers and navigation lines are no constructs.
2. Templates, by equivalence classes. A token's occurrence vector is its number in each page of a site; tokens with equal vectors are a
   class. A vector is known by a 128-bit signature, the XOR of hashes of (page, number), which is aggregated in parts, so a site with a
   third of all pages needs no task of its own. Classes of two or more tokens on two or more pages are ordered by where their tokens
   first stand; a class lies in the one whose span encloses its own. These are the site's template; slots() gives the text between.
3. Clean text. Constructs become text; headings, list items, code and formulas keep a mark (HEADING, ITEM, CODE, FORMULA below).

A construct that stands once on a site has no class, so whether a record holds markup is decided by its tokens, not by classes.

Defined cases: a null or empty text holds none; a record in equal rows counts once; a null uri is a site of its own; a construct cut
off by the end of a unit counts by its visible half.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.session import bounded

#: Element names of HTML and of wiki extensions.
ELEMENTS = "a abbr address article aside audio b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta nav noinclude nowiki ol option p pre q ref references s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead title tr tt u ul var video".split()
#: LaTeX commands that may stand without braces.
COMMANDS = "alpha approx beta cdot cdots chi delta dots epsilon equiv eta exists forall gamma ge geq hline in infty int item kappa lambda ldots le left leftarrow leq maketitle mu nabla ne neq newline newpage nu omega partial phi pi pm prod psi quad qquad rho right rightarrow sigma subset sum tableofcontents tau theta times to xi zeta".split()
HEADING, ITEM, CODE, FORMULA = "\u2042", "\u2022", "\u2983", "\u2a0a"

_ATTRIBUTE = r"""\b(?:href|src|class|style|id|alt)\s*=\s*(?:"[^"<>\n]*"|'[^'<>\n]*')\s*/?>"""
#: (kind, pattern) of constructs that stand at the start of a line.
LINES = [
    ("heading", r"#{1,6}[ \t]+\S"),
    ("heading", r"={1,6}[^=\n]+={1,6}[ \t\r]*$"),
    ("underline", r"(?:={3,}|-{3,}|~{3,}|\^{3,}|\"{3,}|\*{3,}|\+{3,})[ \t\r]*$"),
    ("fence", r"(?:```|~~~)[\w+-]*[ \t\r]*$"),
    ("table", r"\|(?=[^\n]*\|[ \t\r]*$)|\{\||\|\}|\|-"),
    ("table", r":?-{3,}:?[ \t]*\|[ \t:|-]*$"),
    ("quote", r">(?!>)[ \t]*\S"),
    ("item", r"[*-][ \t]+\S"),
    ("directive", r"\.\.[ \t]+(?:[\w:+.-]+::|_[^:\n]+:|\[[^\]\n]+\]|\|[^|\n]+\|)"),
    ("field", r":[A-Za-z][\w-]*(?:[ \t][^:\n]+)?:(?=\s|$)"),
    ("reference", r"\[[^\]\n]+\]:[ \t]+\S"),
]
#: (kind, pattern) of constructs that stand anywhere.
INLINE = [
    ("tag", rf"</?(?i:{'|'.join(sorted(ELEMENTS, key=len, reverse=True))})(?:\s[^<>]*)?/?>"),
    ("tag", rf"<(?i:{'|'.join(sorted(ELEMENTS, key=len, reverse=True))})\s+[a-z-]+\s*=[^<>]*$|<(?i:a|p|div|span|img|td|th|table)[ \t\r]*$"),
    ("tag", r"<!--|<!(?i:doctype)\b|<(?:https?|ftp)://[^\s<>]+>"),
    ("entity", r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"),
    ("link", r"!?\[[^\[\]\n]*\]\((?:https?:|mailto:|\.{0,2}/|#|[\w/-]+\.)[^()\n]*\)"),
    ("link", r"\[\[(?=\S)[^\[\]\n]+\]\]|\[https?://[^\s\]]+(?:[ \t][^\]\n]*)?\]"),
    ("template", r"\{\{(?=\S)[^{}\n]+\}\}"),
    ("literal", r"``[^`\n]+``|(?<!`)`[^`\n]+`(?!`)(?:__?)?"),
    ("strong", r"\*\*(?=\S)[^*\n]+(?<=\S)\*\*|'''?(?=[^\s'])[^'\n]+(?<=[^\s'])'''?|~~(?=\w)[^~\n]+(?<=\w)~~"),
    ("emphasis", r"(?<![\w*\\/])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])|(?<![\w_])__?(?=[^\s_])[^_\n]+(?<=[^\s_])__?(?![\w_])"),
    ("command", rf"(?<![:\w\\])\\(?:[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{{|(?:{'|'.join(COMMANDS)})(?![A-Za-z]))"),
    ("formula", r"\$\$|(?<![\w$\\])\$(?=[^\s$])[^$\n]*[\\^_][^$\n]*(?<=[^\s$])\$(?![\w$])|(?<!\\)\\[\[(](?=[^\n]*\\[\])])"),
    ("literal_block", r"(?<=[\w.)])::[ \t\r]*$"),
]
_LEAD = r"(?=[<&!\[{`*'~_\\$:])"
PATTERN = rf"(?m)^[ \t]*(?:{'|'.join(p for _, p in LINES)})|{_LEAD}(?:{'|'.join(p for _, p in INLINE)})"
#: Where an attribute's end is all that is left of a tag at the start of a unit.
REST = rf"\A[^<>]*?{_ATTRIBUTE}"


def found_tokens(text: Column) -> Column:
    """The constructs of a text, in order."""
    rest = F.filter(F.regexp_extract_all(text, F.lit(f"({REST})"), F.lit(1)), lambda x: x != "")
    return F.concat(rest, F.regexp_extract_all(text, F.lit(f"({PATTERN})"), F.lit(1)))


def _shape(token: Column) -> Column:
    """A token without its content: the tag's name, the delimiter, the command."""
    t = F.trim(token)
    name = F.lower(F.regexp_extract(t, r"^<(/?!?[\w-]*)", 1))
    return (
        F.when(t.startswith("<"), F.concat(F.lit("<"), name, F.lit(">")))
        .when(t.startswith("&"), F.lit("&;"))
        .when(t.startswith("\\"), F.regexp_extract(t, r"^(\\\W|\\[A-Za-z]+)", 1))
        .when(t.startswith(".."), F.concat(F.lit(".. "), F.regexp_extract(t, r"^\.\.\s+([\w:+.-]*::)?", 1)))
        .when(t.rlike(r"^[\w]"), F.lit("attribute"))
        .otherwise(F.regexp_extract(t, r"^([^\w\s]{1,6})", 1))
    )


def tokens(records: DataFrame, table: str, key: str) -> DataFrame:
    """(record_table, record_id, site, tokens) of the records that hold a construct; one row per row."""
    r = records.select(F.lit(table).alias("record_table"), F.col(key).cast("string").alias("record_id"), F.coalesce(F.substring_index("source_uri", "/", 1), F.lit("")).alias("site"), found_tokens(F.col("text")).alias("tokens"))
    return r.filter("record_id is not null and size(tokens) > 0")


def site_templates(marked: DataFrame) -> DataFrame:
    """(site, class_id, inside, pages, total, tokens, valid): equivalence classes of each site's tokens.

    tokens are in the order of their first places; `inside` is the class whose span encloses this one's most closely. Valid classes
    have two tokens and two pages at least, and no tag that closes before it opens. Tokens are shapes, of which there are a few
    hundred at most, so a site's classes are a small group however many pages it has."""
    t = marked.select("site", "record_id", F.posexplode("tokens").alias("at", "token")).select("site", "record_id", "at", _shape(F.col("token")).alias("token"))
    pages = t.groupBy("site", "token", "record_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    vectors = pages.groupBy("site", "token").agg(
        F.bit_xor(F.xxhash64("record_id", "n")).alias("v1"), F.bit_xor(F.xxhash64("n", "record_id")).alias("v2"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("total"), F.avg("first").alias("place")
    )
    classes = vectors.groupBy("site", "v1", "v2", "pages", "total").agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("members"))
    classes = classes.select("site", F.xxhash64("v1", "v2").alias("class_id"), "pages", "total", F.col("members.token").alias("tokens"), F.element_at("members", 1)["place"].alias("lo"), F.element_at("members", -1)["place"].alias("hi"))
    opened = lambda x: F.array_position("tokens", F.regexp_replace(x, "^</", "<"))
    ordered = F.forall("tokens", lambda x: ~x.startswith("</") | (opened(x) == 0) | (opened(x) < F.array_position("tokens", x)))
    classes = classes.withColumn("valid", (F.size("tokens") >= 2) & (F.col("pages") >= 2) & ordered)
    outer = classes.filter("valid").select(F.col("site").alias("_site"), F.col("class_id").alias("inside"), F.col("lo").alias("olo"), F.col("hi").alias("ohi"))
    nested = classes.join(outer, (F.col("site") == F.col("_site")) & (F.col("olo") <= F.col("lo")) & (F.col("ohi") >= F.col("hi")) & ((F.col("ohi") - F.col("olo")) > (F.col("hi") - F.col("lo"))), "left").drop("_site")
    return nested.groupBy("site", "class_id", "pages", "total", "tokens", "valid").agg(F.min_by("inside", F.struct(F.col("ohi") - F.col("olo"), "inside")).alias("inside"))


def held(marked: DataFrame) -> DataFrame:
    """(record_table, record_id) of records with at least one construct."""
    return marked.select("record_table", "record_id").distinct()


_TAG = re.compile(rf"</?(?:{'|'.join(ELEMENTS)})(?:\s[^<>]*)?/?>", re.I)
#: (texts one of which must be there, pattern, replacement): most texts need few of the patterns.
_STEPS = [
    (("<",), re.compile(r"<!--.*?(?:-->|\Z)|<!doctype[^<>]*>", re.S | re.I), ""),
    (("<",), re.compile(r"<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?(.*?)(?:</code>\s*)?</pre>", re.S | re.I), lambda m: _block(CODE, m[1])),
    (("```", "~~~",), re.compile(r"^[ \t]*(```|~~~)[\w+-]*[ \t\r]*\n(.*?)(?:^[ \t]*\1[ \t\r]*$|\Z)", re.S | re.M), lambda m: _block(CODE, m[2])),
    (("::",), re.compile(r"^[ \t]*\.\.[ \t]+(?:code-block|code|sourcecode|literalinclude)::[^\n]*\n((?:[ \t]*\n)*(?:[ \t]+\S[^\n]*(?:\n|\Z)(?:[ \t]*\n(?=[ \t]+\S))*)+)", re.M), lambda m: _block(CODE, m[1])),
    (("$$",), re.compile(r"\$\$(.+?)\$\$", re.S), lambda m: f"{FORMULA} {m[1].strip()} {FORMULA}"),
    (("\\begin",), re.compile(r"\\begin\{(equation|align|math|displaymath)\*?\}(.*?)\\end\{\1\*?\}", re.S), lambda m: f"{FORMULA} {m[2].strip()} {FORMULA}"),
    (("$",), re.compile(r"(?<![\w$\\])\$(?=[^\s$])([^$\n]*[\\^_][^$\n]*)(?<=[^\s$])\$(?![\w$])"), lambda m: f"{FORMULA} {m[1]} {FORMULA}"),
    (("\\",), re.compile(r"\\[(\[]([^\n]*?)\\[)\]]"), lambda m: f"{FORMULA} {m[1].strip()} {FORMULA}"),
]
_AFTER = [
    (("<",), re.compile(r"<h([1-6])\b[^<>]*>(.*?)</h\1>", re.S | re.I), lambda m: f"\n{HEADING} {m[2].strip()}\n"),
    (("<",), re.compile(r"<li\b[^<>]*>", re.I), f"\n{ITEM} "),
    (("<",), re.compile(r"</t[dh]>\s*(?=<t[dh])", re.I), "\t"),
    (("<",), re.compile(r"<(?:br|/p|/tr|/li|/ul|/ol|/table|/div)\b[^<>]*>\n?", re.I), "\n"),
    (("<",), re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", re.S | re.I), ""),
    (("<",), _TAG, ""),
    (("<",), re.compile(r"<((?:https?|ftp)://[^\s<>]+)>(?!`)"), r"\1"),
    (("===", "---", "~~~", "^^^", '"""', "***", "+++",), re.compile(r"^(?=[ \t]*\S)([^\n]*)\n(?=[=\-~^\"*+]{3})(?:=+|-+|~+|\^+|\"+|\*+|\++)[ \t\r]*$", re.M), rf"{HEADING} \1"),
    (("===", "---", "~~~", "^^^", '"""', "***", "+++",), re.compile(r"^(?:={3,}|-{3,}|~{3,}|\^{3,}|\"{3,}|\*{3,}|\+{3,})[ \t\r]*\n?", re.M), ""),
    (("=",), re.compile(r"^={1,6}[ \t]*([^=\n]+?)[ \t]*={1,6}[ \t\r]*$", re.M), rf"{HEADING} \1"),
    (("#",), re.compile(r"^#{2,6}[ \t]+", re.M), f"{HEADING} "),
    (("#",), re.compile(r"^#[ \t]+(?=[^\n]*(?:\n#[ \t]|\Z))|(?<=\n)(?<=[^\n]\n)#[ \t]+", re.M), f"{ITEM} "),
    (("#",), re.compile(r"^#[ \t]+", re.M), f"{HEADING} "),
    (("*", "-",), re.compile(r"^[ \t]*[*-][ \t]+(?=\S)", re.M), f"{ITEM} "),
    (("\\",), re.compile(r"\\(?:sub)*section\*?\{([^{}\n]*)\}"), rf"\n{HEADING} \1\n"),
    (("\\",), re.compile(r"^[ \t]*\\(?:begin|end)\{[^{}\n]*\}[ \t]*\n?|\\(?:begin|end)\{[^{}\n]*\}", re.M), ""),
    (("\\",), re.compile(r"^[ \t]*\\item\b[ \t]*", re.M), f"{ITEM} "),
    (("\\",), re.compile(r"(?<![:\w\\])\\(?:cite|ref|label)\{[^{}\n]*\}"), ""),
    (("\\",), re.compile(r"(?<![:\w\\])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}"), r"\1"),
    (("..",), re.compile(r"^[ \t]*\.\.[ \t]+[\w:+.-]+::[ \t]*", re.M), ""),
    (("..",), re.compile(r"^[ \t]*\.\.[ \t]+(?:_[^:\n]+:|\[[^\]\n]+\])[ \t]*", re.M), ""),
    ((":",), re.compile(r"^[ \t]*:([A-Za-z][\w-]*(?:[ \t][^:\n]+)?):(?=\s|$)", re.M), r"\1:"),
    (("::",), re.compile(r"(?<=[\w.)])::[ \t\r]*$", re.M), ":"),
    (("`",), re.compile(r"(?::[a-z][\w:+.-]*:)?`([^`<\n]*?)\s*<[^`<>\n]*>`__?"), r"\1"),
    (("`",), re.compile(r":[a-z][\w:+.-]*:`([^`\n]+)`"), r"\1"),
    (("`",), re.compile(r"``([^`\n]+)``|(?<!`)`([^`\n]+)`(?!`)_{0,2}"), lambda m: m[1] or m[2]),
    (("](",), re.compile(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"),
    (("[[",), re.compile(r"\[\[(?:Category|File|Image|Kategorie|Datei)\s*:[^\[\]\n]*\]\]", re.I), ""),
    (("[[",), re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]"), r"\1"),
    (("[http",), re.compile(r"\[https?://[^\s\]]+[ \t]+([^\]\n]*)\]"), r"\1"),
    (("[http",), re.compile(r"\[(https?://[^\s\]]+)\]"), r"\1"),
    (("{{",), re.compile(r"\{\{[^{}\n]+\}\}"), ""),
    (("**",), re.compile(r"\*\*(?=\S)([^*\n]+)(?<=\S)\*\*"), r"\1"),
    (("''",), re.compile(r"'''?(?=[^\s'])([^'\n]+)(?<=[^\s'])'''?"), r"\1"),
    (("~~",), re.compile(r"~~(?=\w)([^~\n]+)(?<=\w)~~"), r"\1"),
    (("*",), re.compile(r"(?<![\w*\\/])\*(?=[^\s*])([^*\n]+)(?<=[^\s*])\*(?![\w*])"), r"\1"),
    (("_",), re.compile(r"(?<![\w_])__?(?=[^\s_])([^_\n]+)(?<=[^\s_])__?(?![\w_])"), r"\1"),
    (("|",), re.compile(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[ \t:|-]*\n?", re.M), ""),
    (("|",), re.compile(r"^[ \t]*\|([^\n]*)\|[ \t\r]*$", re.M), lambda m: "\t".join(x.strip() for x in m[1].split("|"))),
    (("|",), re.compile(r"^[ \t]*(?:\{\||\|\}|\|-)[^\n]*\n?", re.M), ""),
    (("]:",), re.compile(r"^[ \t]*\[[^\]\n]+\]:[ \t]+\S+[^\n]*\n?", re.M), ""),
    ((">",), re.compile(r"^[ \t]*>(?!>)[ \t]?", re.M), ""),
]


_KEPT = re.compile(rf"((?:^{CODE} [^\n]*(?:\n|\Z))+|{FORMULA} .*? {FORMULA})", re.M)
_GAPS = re.compile(r"\n{3,}")


def _replaced(text: str, steps: list) -> str:
    for needles, pattern, to in steps:
        if any(n in text for n in needles):
            text = pattern.sub(to, text)
    return text


def _block(mark: str, text: str) -> str:
    lines = [x for x in html.unescape(text).strip("\n").split("\n")]
    return "\n" + "\n".join(f"{mark} {x}" for x in lines) + "\n"


def clean_text(text: str) -> str:
    """Text without markup; code lines begin with CODE and are left as they are, as are formulas between two FORMULA."""
    text = _replaced(text, _STEPS)
    pieces = _KEPT.split(text) if CODE in text or FORMULA in text else [text]
    for k in range(0, len(pieces), 2):
        pieces[k] = _replaced(pieces[k], _AFTER)
        if "&" in pieces[k]:
            pieces[k] = html.unescape(html.unescape(pieces[k]))
        pieces[k] = pieces[k].replace("\u00a0", " ")
    return _GAPS.sub("\n\n", "".join(pieces)).strip("\n")


def cleaned(records: DataFrame, table: str, key: str) -> DataFrame:
    """(record_table, record_id, text, n_tokens, n_headings, n_items, n_code, n_formulas) of every record with a text; those without
    constructs keep theirs as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [clean_text(t) if n else t for t, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), b.column(3)], ["record_table", "record_id", "text", "n_tokens"])

    r = records.filter(F.col("text").isNotNull()).select(F.lit(table).alias("record_table"), F.col(key).cast("string").alias("record_id"), "text", F.size(found_tokens(F.col("text"))).alias("n_tokens"))
    done = r.mapInArrow(run, "record_table string, record_id string, text string, n_tokens int")
    count = lambda mark: F.size(F.split("text", mark)) - 1
    return done.withColumns({"n_headings": count(HEADING), "n_items": count(ITEM), "n_code": count(CODE), "n_formulas": F.floor(count(FORMULA) / 2)})


#: A noncharacter that parts constructs from text; taken out of texts first.
_CUT = "\ufdd0"
_FENCE = re.compile(r"[ \t]*(?:```|~~~)[\w+-]*[ \t\r]*\Z")


def slot_texts(pieces: list[str], shapes: list[str | None], classes: dict[str, int]) -> list[tuple[int | None, str]]:
    """(class, clean text) of the slots of a page, from its texts and constructs by turns. A construct of CLASSES ends a slot and begins
    the next, whose text has what stands inside the construct; other constructs stay in their slot. Between fences all is code."""
    out: list[tuple[int | None, list[str], bool]] = [(None, [], False)]
    fenced = False
    for piece, shape in zip(pieces, shapes, strict=True):
        if shape in classes:
            fence = bool(_FENCE.match(piece))
            fenced = fenced != fence
            out.append((classes[shape], [] if fence else [piece], fenced))
        else:
            out[-1][1].append(piece)
    made = [(c, _block(CODE, "".join(x)).strip("\n") if code and "".join(x).strip() else clean_text("".join(x))) for c, x, code in out]
    return [(c, t) for c, t in made if t.strip()]


def slots(records: DataFrame, templates: DataFrame, table: str, key: str) -> DataFrame:
    """(record_table, record_id, slot, class_id, text): every record of a site with valid classes, cut at their tokens. class_id is the
    class of the token that begins the slot, null before the first; empty slots are left out of the numbering."""
    tokens_ = templates.filter("valid").select("site", "class_id", F.explode("tokens").alias("token"))
    classes = bounded(tokens_.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("token", "class_id"))).alias("classes")))
    text = F.regexp_replace(F.regexp_replace("text", _CUT, ""), f"({REST}|{PATTERN})", f"{_CUT}$1{_CUT}")
    r = records.filter("text is not null").select(F.lit(table).alias("record_table"), F.col(key).cast("string").alias("record_id"), F.coalesce(F.substring_index("source_uri", "/", 1), F.lit("")).alias("site"), F.split(text, _CUT).alias("pieces")).filter("record_id is not null")
    shapes = F.transform("pieces", lambda x, i: F.when(i % 2 == 1, _shape(x)))
    r = r.join(classes, "site").select("record_table", "record_id", "pieces", shapes.alias("shapes"), F.map_keys("classes").alias("names"), F.map_values("classes").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tab, record, pieces, shapes, names, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(tab, record, k, c, t) for k, (c, t) in enumerate(slot_texts(pieces, shapes, dict(zip(names, ids, strict=True))), 1)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], ["record_table", "record_id", "slot", "class_id", "text"])

    return r.mapInArrow(run, "record_table string, record_id string, slot int, class_id bigint, text string").distinct()

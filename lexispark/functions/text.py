"""Text functions as Columns; all run inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the embedders leave out.
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that",
    "the", "to", "was", "were", "will", "with", "this", "but", "they", "have", "had", "what", "when", "where", "who", "which", "why", "how",
    "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "can", "should", "now", "i", "you", "we", "our", "your", "if", "then", "else", "end", "begin", "proc",
    "int", "string", "call", "return",
]
#: Suffixes that the stemmer strips from words of more than six letters, the first that fits.
SUFFIXES = ["ation", "ment", "ing", "ed", "ly", "er", "es", "s"]
TOKEN = "[a-z][a-z0-9_]*"
#: What Python's str.strip() removes.
BLANKS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


_BLANK_CHARACTERS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK_CHARACTERS))


def tokenize(text: Column) -> Column:
    """Lower-cased words that begin with an ASCII letter."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def bigrams(tokens: Column) -> Column:
    """Adjacent tokens joined by an underscore."""
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.filter(pairs, lambda x: x.isNotNull())


def with_bigrams(tokens: Column) -> Column:
    return F.concat(tokens, bigrams(tokens))


def remove_stopwords(tokens: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Tokens that aren't stopwords, repeated ones kept."""
    return F.filter(tokens, lambda t: ~t.isin(stopwords))


def stem(word: Column) -> Column:
    out = F.when(F.length(word) <= 6, word)
    for suffix in SUFFIXES:
        fits = F.endswith(word, F.lit(suffix))
        if suffix == "s":
            fits = fits & ~F.endswith(word, F.lit("ss"))
        out = out.when(fits, F.substring(word, F.lit(1), F.length(word) - len(suffix)))
    return out.otherwise(word)


def _hex_mod(digest: Column, n: int) -> Column:
    """A hexadecimal number of 32 digits modulo n: the last digits where n is a power of two, else by limbs of 28 bits."""
    if n & (n - 1) == 0 and n <= 1 << 28:
        digits = max(1, -(-(n.bit_length() - 1) // 4))
        value = sum(((F.instr(F.lit("0123456789abcdef"), F.substring(digest, 32 - k, 1)) - 1).cast("long") * 16**k for k in range(digits)), F.lit(0).cast("long"))
        return value % n
    out = F.lit(0).cast("long")
    for at, size in ((1, 4), (5, 7), (12, 7), (19, 7), (26, 7)):
        out = (out * (16**size % n) + F.conv(F.substring(digest, at, size), 16, 10).cast("long") % n) % n
    return out


def hash_term(term: Column, n_features: int) -> tuple[Column, Column]:
    """Index (MD5 modulo n_features) and sign (parity of SHA-1) of a term."""
    if not 0 < n_features < 1 << 31:
        raise ValueError("n_features is out of range")
    even = F.instr(F.lit("02468ace"), F.right(F.sha1(term), F.lit(1))) > 0
    return _hex_mod(F.md5(term), n_features), F.when(even, 1).otherwise(-1)


#: Letters whose capital is several letters; SQL leaves them as they are.
_SEVERAL = "\u0149\u01f0\u0390\u03b0\u0587\u1e96\u1e97\u1e98\u1e99\u1e9a\u1f50\u1f52\u1f54\u1f56" + "".join(map(chr, [*range(0x1F88, 0x1F90), *range(0x1F98, 0x1FA0), *range(0x1FA8, 0x1FB0)])) + (
    "\u1fb2\u1fb4\u1fb6\u1fb7\u1fbc\u1fc2\u1fc4\u1fc6\u1fc7\u1fcc\u1fd2\u1fd3\u1fd6\u1fd7\u1fe2\u1fe3\u1fe4\u1fe6\u1fe7\u1ff2\u1ff4\u1ff6\u1ff7\u1ffc\ufb00\ufb01\ufb02\ufb03\ufb04\ufb05\ufb06\ufb13\ufb14\ufb15\ufb16\ufb17"
)


def is_heading(text: Column, ascii: bool = False) -> Column:
    """Short paragraphs that look like a heading: capitals, numbered, title case, or capitals with digits."""
    return F.element_at(F.transform(F.array(F.btrim(text, F.lit(_BLANK_CHARACTERS.replace("\x0b", ""))) if ascii else strip(text)), lambda t: heads(t, ascii)), 1)


def heads(t: Column, ascii: bool = False) -> Column:
    """As :func:`is_heading`, for a paragraph without blanks around it; long ones are told by their length alone.

    ``ascii``: digits, blanks and the letter after a number are ASCII, capitals single letters, as in SQL; else as in Python.
    """
    u, blank, word = ("", r"[\t\n\f\r ]", "[0-9A-Za-z_]") if ascii else ("(?U)", r"\s", r"\w")
    blanks = blank[1:-1] if ascii else blank
    cased = F.translate(t, _SEVERAL, "") if ascii else t
    upper = (F.upper(cased) == cased) & (F.lower(t) != t)
    numbered = t.rlike(rf"^{u}\d+\.?{blank}+{word}")
    title = t.rlike(rf"^[A-Z][a-z]+({u and '?U:' or '?:'}{blank}+[A-Z][a-z]+)*\z")
    capitals = t.rlike(rf"^({u and '?U:' or '?:'}[A-Z0-9{blanks}\-:])+\z") & (F.length(t) < 80)
    return F.when(F.length(t).between(1, 99), ~t.rlike(r"[.,;:]\z") & (upper | numbered | title | capitals)).otherwise(False)


def format_table(rows: Column) -> Column:
    """Rows of cells as lines; null cells are empty, empty rows left out."""
    rows = F.filter(rows, lambda r: F.size(r) > 0)
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")


def chunk_id(source_type: Column, path: Column, text: Column, extra: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(source_type, F.lit("_"), F.left(F.md5(F.concat_ws(":", blank(path), F.left(blank(text), F.lit(200)), blank(extra))), F.lit(12)))


def fallback_id(path: Column, text: Column) -> Column:
    return F.left(F.md5(F.concat(F.coalesce(path, F.lit("")), F.lit(":"), F.left(F.coalesce(text, F.lit("")), F.lit(100)))), F.lit(12))


def source_ref(path: Column, line_start: Column, line_end: Column, procedure: Column, page: Column, timestamp: Column) -> Column:
    """A reference as text: path, lines, procedure, page and time, as far as they are known."""
    lines = F.when(line_start.isNotNull() & line_end.isNotNull(), F.concat(F.lit("lines "), line_start.cast("string"), F.lit("-"), line_end.cast("string"))).when(
        line_start.isNotNull(), F.concat(F.lit("line "), line_start.cast("string"))
    )
    return F.concat_ws(":", path, lines, F.concat(F.lit("proc "), procedure), F.concat(F.lit("page "), page.cast("string")), F.concat(F.lit("@ "), timestamp))


#: How embedding texts begin, by semantic type.
PREFIXES = {
    "procedure": "TAL procedure that",
    "subproc": "TAL subprocedure that",
    "variable_declaration": "Variable declaration for",
    "structure_definition": "Data structure definition for",
    "section": "Document section about",
    "paragraph": "Document content about",
    "table": "Data table showing",
    "error_trace": "Error trace for",
    "transaction": "Transaction record for",
    "audit_entry": "Audit log entry for",
}


def embedding_text(text: Column, semantic_type: Column, matches: Column, procedure: Column, section: Column) -> Column:
    """What is embedded for a chunk: its type, up to five concepts and capabilities in the order they appear, its name, its text cut to 1,500 characters in all."""
    prefix = F.lit("Content related to")
    for kind, said in PREFIXES.items():
        prefix = F.when(semantic_type == kind, said).otherwise(prefix)
    concepts = F.array_distinct(F.transform(F.slice(matches, 1, 5), lambda m: m["canonical_term"]))
    caps = F.slice(F.array_distinct(F.flatten(F.transform(matches, lambda m: F.slice(m["capabilities"], 1, 2)))), 1, 5)
    head = F.array_compact(
        F.array(
            F.when(F.size(matches) > 0, F.concat(prefix, F.lit(" "), F.array_join(concepts, ", "), F.lit("."))),
            F.when((F.size(matches) > 0) & (F.size(caps) > 0), F.concat(F.lit("Business capabilities: "), F.array_join(caps, ", "), F.lit("."))),
            F.concat(F.lit("Procedure: "), procedure),
            F.concat(F.lit("Section: "), section),
        )
    )
    room = F.greatest(F.lit(0), F.lit(1500) - F.aggregate(head, F.lit(0), lambda a, x: a + F.length(x)))
    return F.array_join(F.concat(head, F.array(F.substring(text, F.lit(1), room))), " ")


#: What looks like a keyword: CamelCase, snake_case, UPPER_CASE, acronyms, hyphenated words.
KEYWORDS = [r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", r"\b[a-z]+(?:_[a-z]+)+\b", r"\b[A-Z]+(?:_[A-Z]+)+\b", r"\b[A-Z]{2,}\b", r"\b[a-z]+(?:-[a-z]+)+\b"]
#: The same matches without going back, which Java does by recursion: an identifier of any length is one loop.
_LINEAR = [r"\b[A-Z][a-z]++(?:[A-Z][a-z]++)++\b", r"\b[a-z]++(?:_[a-z]++)++\b", r"\b[A-Z]++(?:_[A-Z]++)++\b", r"\b[A-Z]{2,}+\b", r"\b[a-z]++(?:-[a-z]++\b)++"]


def distinct_ignoring_case(x: Column) -> Column:
    """The first of each element without regard to case, in order: two sorts, whatever their number."""

    def firsts(s: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda e: e["low"]))
        marked = F.zip_with(s, F.when(F.size(s) > 0, before).otherwise(F.array().cast("array<string>")), lambda e, b: F.struct(e["i"].alias("i"), e["v"].alias("v"), (b.isNull() | (b != e["low"])).alias("first")))
        return F.transform(F.array_sort(F.filter(marked, lambda e: e["first"])), lambda e: e["v"])

    keyed = F.array_sort(F.transform(x, lambda v, i: F.struct(F.lower(v).alias("low"), i.alias("i"), v.alias("v"))))
    return F.element_at(F.transform(F.array(keyed), firsts), 1)


def extract_keywords(text: Column) -> Column:
    return distinct_ignoring_case(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?U){p}"), 0) for p in _LINEAR]))


def extract_tal_keywords(code: Column) -> Column:
    """System functions, called procedures, names in capitals and string literals; sorted."""
    found = [
        F.regexp_extract_all(code, F.lit(r"\$[A-Z][A-Z0-9_]*"), 0),
        F.regexp_extract_all(code, F.lit(r"(?i)CALL\s+([A-Za-z_][A-Za-z0-9_\^]*)"), 1),
        F.regexp_extract_all(code, F.lit(r"(?U)\b([A-Z][A-Z0-9_]{3,})\b"), 1),
        F.regexp_extract_all(code, F.lit(r'"([^"]+)"'), 1),
    ]
    return F.array_sort(F.array_distinct(F.concat(*found)))


#: Where a chunk may end, in order of preference.
BREAKS = [". ", ".\n", "\n\n", "\n", " "]


def chunk_text(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Overlapping chunks of at most ``size`` characters, each ending after the last break in its second half.

    A fold over as many steps as the shortest possible advance needs; a step reads one window of the text.
    """
    if not 0 <= overlap < size // 2:
        raise ValueError("overlap has to be less than half of size")
    # a lambda's variable is computed once, whatever expression ``text`` is
    return F.element_at(F.transform(F.array(text), lambda t: _chunks(t, size, overlap)), 1)


def _chunks(text: Column, size: int, overlap: int) -> Column:
    n = F.length(text)
    half = size // 2
    steps = F.ceil(n / (half - overlap)).cast("int") + 2

    def end_of(start: Column) -> Column:
        second = F.substring(text, start + half + 1, F.lit(size - half))
        back = F.reverse(second)
        out = F.lit(size)
        for sep in reversed(BREAKS):
            at = F.instr(back, sep[::-1])
            # instr on the reversed window gives the last break that lies wholly inside
            place = F.when(at > 0, F.lit(size) - (at - 1))
            out = F.coalesce(place, out)
        return F.when(start + size < n, start + out).otherwise(start + size)

    zero = F.lit(0)
    state = F.struct(zero.alias("start"), F.array().cast("array<string>").alias("chunks"))

    def step(a: Column, _: Column) -> Column:
        end = end_of(a["start"])
        piece = strip(F.substring(text, a["start"] + 1, end - a["start"]))
        return F.when(
            a["start"] < n,
            F.struct((end - overlap).cast("int").alias("start"), F.when(piece != "", F.concat(a["chunks"], F.array(piece))).otherwise(a["chunks"]).alias("chunks")),
        ).otherwise(a)

    folded = F.aggregate(F.sequence(F.lit(1), steps), state, step, lambda a: a["chunks"])
    return F.when(n <= size, F.array(text)).otherwise(folded)


def strip_tags(html: Column) -> Column:
    """Text of HTML without a parser: tags become blanks, runs of white space one blank."""
    tail = F.substring_index(html, ">", -1)  # no tag ends in it, and each "<" would look for one
    head = F.left(html, F.length(html) - F.length(tail))
    return strip(F.regexp_replace(F.concat(F.regexp_replace(head, "<[^>]+>", " "), tail), rf"{BLANKS}+", " "))


def sanitize_for_llm(text: Column) -> Column:
    """Control, format, private and unassigned characters and odd blanks become blanks, but \\n, \\t and \\r; at most one empty line in a row."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^\n\t\r ]]", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def l2_normalize(a: Column) -> Column:
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: x / size))

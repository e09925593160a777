"""License scans: ordered signature rules, in DataFrame and SQL functions only.

A text is lower-cased (A-Z) and reduced to its words, single blanks between. Four base phrases are
found wherever their words stand consecutively. Further, signature rules with priorities are run on
texts that hold their family's keyword: hundreds of regular expressions over the words, from lists
of families, versions and wordings. Detections are intervals of words; one that lies within an
interval of higher priority is suppressed, so that "gnu lesser general public license version 2.1"
is not also a general mention of its parts. Labels of the base phrases are never suppressed.

Priorities: 3 for identifiers and full titles with version, 2 for titles without, 1 for notices, 0
for hints. The score is the largest confidence of what was found: 1, 0.9, 0.7 and 0.4 by priority,
and 0.9 for base phrases alone.

Cases: null and empty texts have no words, no labels (empty strings) and score 0; first_word and
last_word are null where no base phrase stands. Repeated rows are scanned alike. Texts of any length
are scanned whole, and suppression takes time in proportion to the detections of a text, times the
logarithm for sorting. An empty table gives an empty result. Columns beside those named are carried
or left, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import LOWER, UPPER

#: Contract: phrase and label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
CONFIDENCE = {3: 1.0, 2: 0.9, 1: 0.7, 0: 0.4}
BASE_CONFIDENCE = 0.9

V = "(?:v|ver|version|version v)? ?"
LICENSE = "licen[sc]e"


def rules() -> list[tuple[str, str, int, str]]:
    """(keyword, pattern, priority, label). Patterns match whole words, single blanks between."""
    out: list[tuple[str, str, int, str]] = []

    def add(keyword: str, priority: int, label: str, *patterns: str) -> None:
        out.extend((keyword, p, priority, label) for p in patterns)

    # Copyleft families of one publisher: name words, short name, versions.
    for name, short, versions in (("general public", "gpl", ("1", "2", "3")), ("lesser general public", "lgpl", ("2 1", "3")), ("library general public", "lgpl", ("2",)), ("affero general public", "agpl", ("1", "3")), ("free documentation", "gfdl", ("1 1", "1 2", "1 3"))):
        title = f"gnu {name} {LICENSE}"
        for v in versions:
            number = v + ("(?: 0)?" if " " not in v else "")
            add("gnu", 3, f"{short}-{v.replace(' ', '.')}", f"{title} (?:as published by the free software foundation )?{V}{number}")
            add("gnu", 3, f"{short}-{v.replace(' ', '.')}-or-later", f"{title} (?:as published by the free software foundation )?(?:either )?{V}{number}(?: of the {LICENSE})? or (?:at your option )?any later version")
            add(short, 3, f"{short}-{v.replace(' ', '.')}", f"{short} ?{V}{number}", f"{short} {number} only")
            add(short, 3, f"{short}-{v.replace(' ', '.')}-or-later", f"{short} {number} or later")
        if name != "general public":
            add("gnu", 2, short, title)
        add(short, 1, short, f"(?:under|the) (?:the )?{short}(?: {LICENSE})?", f"gnu {short}")

    # Public licences with versions: keyword, words of the title, label, versions.
    for keyword, title, label, versions in (
        ("apache", f"apache(?: software)? {LICENSE}", "apache", ("1 0", "1 1", "2 0")),
        ("mozilla", f"mozilla public {LICENSE}", "mpl", ("1 0", "1 1", "2 0")),
        ("eclipse", f"eclipse public {LICENSE}", "epl", ("1 0", "2 0")),
        ("common", f"common development and distribution {LICENSE}", "cddl", ("1 0", "1 1")),
        ("common", f"common public {LICENSE}", "cpl", ("1 0",)),
        ("european", f"european union public {LICENSE}", "eupl", ("1 0", "1 1", "1 2")),
        ("artistic", f"artistic {LICENSE}", "artistic", ("1 0", "2 0")),
        ("academic", f"academic free {LICENSE}", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
        ("open", f"open software {LICENSE}", "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
        ("boost", f"boost software {LICENSE}", "bsl", ("1 0",)),
        ("microsoft", f"microsoft public {LICENSE}", "ms-pl", ()),
        ("microsoft", f"microsoft reciprocal {LICENSE}", "ms-rl", ()),
        ("python", f"python(?: software foundation)? {LICENSE}", "psf", ("2 0",)),
        ("zope", f"zope public {LICENSE}", "zpl", ("1 1", "2 0", "2 1")),
        ("zlib", f"zlib(?: libpng)? {LICENSE}", "zlib", ()),
        ("isc", f"isc {LICENSE}", "isc", ()),
        ("openssl", f"openssl {LICENSE}", "openssl", ()),
        ("php", f"php {LICENSE}", "php", ("3 0", "3 01")),
        ("ruby", f"ruby {LICENSE}", "ruby", ()),
        ("w3c", f"w3c(?: software)?(?: notice and)? {LICENSE}", "w3c", ()),
        ("sil", f"sil open font {LICENSE}", "ofl", ("1 0", "1 1")),
        ("database", f"open database {LICENSE}", "odbl", ("1 0",)),
        ("commons", f"open data commons attribution {LICENSE}", "odc-by", ("1 0",)),
        ("blue", f"blue oak model {LICENSE}", "blueoak", ("1 0 0",)),
        ("mulan", f"mulan p(?:ermissive software|sl) {LICENSE}", "mulanpsl", ("1", "2")),
        ("cecill", f"cecill(?: free software)? {LICENSE}", "cecill", ("1 1", "2 0", "2 1")),
        ("universal", f"universal permissive {LICENSE}", "upl", ("1 0",)),
        ("ibm", f"ibm public {LICENSE}", "ipl", ("1 0",)),
        ("netscape", f"netscape public {LICENSE}", "npl", ("1 0", "1 1")),
        ("sun", f"sun (?:public|industry standards source) {LICENSE}", "sun", ("1 0",)),
        ("q", f"q public {LICENSE}", "qpl", ("1 0",)),
        ("ntp", f"ntp {LICENSE}", "ntp", ()),
        ("postgresql", f"postgresql {LICENSE}", "postgresql", ()),
        ("vim", f"vim {LICENSE}", "vim", ()),
        ("beerware", f"beerware {LICENSE}", "beerware", ()),
        ("beer", f"beer ware {LICENSE}", "beerware", ()),
        ("wtfpl", "wtfpl", "wtfpl", ()),
        ("want", "do what the f\\S+ you want to public licen[sc]e", "wtfpl", ()),
    ):
        for v in versions:
            number = v if not v.endswith(" 0") else v[:-2] + "(?: 0)?"
            add(keyword, 3, f"{label}-{v.replace(' ', '.')}", f"{title} {V}{number}")
        add(keyword, 2, label, title)
        add(keyword, 1, label, f"(?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?{title}")

    # Creative Commons: six licences by five versions, by title and by identifier.
    for code, words in (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s?"), ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?")):
        label = "cc-" + code.replace(" ", "-")
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            add("cc", 3, f"{label}-{v.replace(' ', '.')}", f"cc {code} {v}")
            add("creative", 3, f"{label}-{v.replace(' ', '.')}", f"creative commons {words} {V}{v}(?: international| unported| generic)?(?: {LICENSE})?")
        if code != "by":
            add("cc", 2, label, f"cc {code}")
        add("creative", 2, label, f"creative commons {words}(?: {LICENSE})?")
    add("cc", 3, "cc0-1.0", "cc ?0 1 0", "cc ?zero 1 0")
    add("creative", 2, "cc0-1.0", "creative commons (?:zero|cc0)(?: universal)?(?: public domain dedication)?")
    add("creative", 1, "cc", f"creative commons(?: {LICENSE})?")

    # Short permissive licences, by the words of their texts.
    for n, words in (("0", "zero"), ("2", "two"), ("3", "three"), ("4", "four")):
        add("bsd", 3, f"bsd-{n}-clause", f"bsd (?:{n}|{words}) clause(?: {LICENSE})?", f"(?:{n}|{words}) clause bsd(?: {LICENSE})?")
    add("bsd", 2, "bsd", f"bsd(?: style)? {LICENSE}", "bsd licensed")
    add("redistribution", 2, "bsd", "redistribution and use in source and binary forms with or without modification are permitted")
    add("mit", 2, "mit", f"(?:the )?(?:mit x11|mit) {LICENSE}", "mit licensed")
    add("expat", 2, "mit", f"(?:the )?expat {LICENSE}")
    add("permission", 2, "mit", "permission is hereby granted free of charge to any person obtaining a copy")
    add("permission", 2, "isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted")
    add("permission", 1, "permissive", "permission is (?:hereby )?granted")
    add("unlicense", 2, "unlicense", "the unlicense", "unlicense org")
    add("domain", 2, "public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain dedication")
    add("domain", 0, "public-domain", "(?:in the )?public domain")
    add("free", 1, "free-software", "this (?:program|library|work) is free software", "free software foundation")
    add("proprietary", 1, "proprietary", "proprietary and confidential", f"proprietary {LICENSE}", "proprietary software")
    add("reserved", 1, "all-rights-reserved", "all rights reserved")
    add("copyright", 0, "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright notice")
    add("copyrighted", 0, "copyright", "copyrighted by")
    add("commercial", 1, "non-commercial", "(?:for )?non commercial use only", "not for commercial use", "no commercial use")
    add("noncommercial", 1, "non-commercial", "(?:for )?noncommercial use only")
    add("commercial", 1, "commercial", f"commercial {LICENSE}")
    add("redistribute", 0, "notice", "you (?:can|may) redistribute it and(?: or)? modify it", "may not redistribute")
    add("warranty", 0, "warranty", "without (?:any )?warranty of any kind", "as is without warranty", "no warranty")
    add("spdx", 3, "spdx", "spdx licen[sc]e identifier \\S+")
    add("eula", 1, "eula", "eula")
    add("agreement", 1, "eula", "end user licen[sc]e agreement")
    for verb in ("licensed", "released", "distributed", "published", "available", "provided"):
        add(verb, 0, "notice", f"{verb} under (?:the )?(?:terms|conditions) of", f"{verb} under an? \\S+ {LICENSE}", f"{verb} under the \\S+ {LICENSE}")
    return out


#: What stands between words.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words with single blanks between and a blank at either end; not lower-cased."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, NO_WORD, " ")), F.lit(" "))


def count_words(words: Column) -> Column:
    """Of a text in which a blank follows every word."""
    return F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def base_places(words: Column, phrase: str) -> Column:
    """(n, first, last): how often a phrase stands, and the word numbers of its first and last place."""

    def found(gaps: Column) -> Column:
        n = F.size(gaps) - 1
        last = count_words(words) - count_words(F.element_at(gaps, -1)) - len(phrase.split())
        return F.struct(n.cast("long").alias("n"), F.when(n > 0, count_words(gaps[0])).cast("long").alias("first"), F.when(n > 0, last).cast("long").alias("last"))

    return let(F.split(words, F.lit(f" {phrase}(?= )")), found)


#: Set around matches; neither can stand in a word.
OPEN, CLOSE = "\x01", "\x02"


def intervals(words: Column, pattern: Column) -> Column:
    """(start, end) word numbers of the matches of a pattern over whole words."""
    marked = F.regexp_replace(words, F.concat(F.lit(" ("), pattern, F.lit(")(?= )")), F.lit(f" {OPEN}$1{CLOSE}"))

    def numbered(tokens: Column) -> Column:
        number = lambda test: F.filter(F.transform(tokens, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
        starts, ends = number(lambda w: w.startswith(OPEN)), number(lambda w: w.endswith(CLOSE))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))

    return let(F.split(F.trim(marked), " "), numbered)


def detections(words: Column, keywords: Column, table: list[tuple[str, str, int, str]]) -> Column:
    """All matches of the rules of the keywords: start, -end, -priority and label, sorted so that an
    interval comes after those that contain it."""
    rows = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(p).alias("pattern"), F.lit(n).alias("priority"), F.lit(x).alias("label")) for k, p, n, x in table])
    of_keywords = let(keywords, lambda known: F.filter(rows, lambda r: F.array_contains(known, r["keyword"])))
    meant = F.filter(of_keywords, lambda r: F.regexp(words, F.concat(F.lit(" (?:"), r["pattern"], F.lit(") "))))
    found = F.transform(meant, lambda r: F.transform(intervals(words, r["pattern"]), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), (-r["priority"]).alias("rank"), r["label"].alias("label"))))
    return F.array_sort(F.flatten(found))


def gate_words(table: list[tuple[str, str, int, str]]) -> dict[str, list[str]]:
    """The words of which a text must hold one, for the rules of each keyword: the keyword, or a rarer
    word of all its patterns. Short names may run on into a version, as in "gplv3" or "cc0"."""
    out = {k: [k] for k, *_ in table}
    for short in ("gpl", "lgpl", "agpl", "gfdl"):
        out[short] = [short + v + n for v in ("", "v", "ver", "version") for n in ("", "1", "2", "3")]
    out["cc"] = ["cc", "cc0", "cczero"]
    out["mit"], out["beer"] = ["license", "licence", "licensed"], ["ware"]
    return out


def hit_keywords(words: Column, held: Column, table: list[tuple[str, str, int, str]]) -> Column:
    """Keywords of which a gate word is held and some rule matches: one literal alternation for each,
    compiled once."""
    hits = []
    for k, names in gate_words(table).items():
        pattern = " (?:" + "|".join(dict.fromkeys(p for key, p, *_ in table if key == k)) + ") "
        held_one = F.array_contains(held, names[0]) if len(names) == 1 else F.arrays_overlap(held, F.array(*map(F.lit, names)))
        hits.append(F.when(held_one & F.regexp(words, F.lit(pattern)), F.lit(k)))
    return F.array_compact(F.array(*hits))


def unsuppressed(found: Column) -> Column:
    """(labels, best): distinct labels of the detections that no interval of higher priority holds,
    and the highest priority among them (-1: none). One pass, with the furthest end so far by priority."""
    start = F.struct(*[F.lit(-1).alias(f"m{p}") for p in range(4)], F.array().cast("array<string>").alias("labels"), F.lit(-1).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        end, p = -x["back"], -x["rank"]
        above = F.when(p == 0, F.greatest(acc["m1"], acc["m2"], acc["m3"])).when(p == 1, F.greatest(acc["m2"], acc["m3"])).when(p == 2, acc["m3"]).otherwise(-1)
        kept = above < end
        return F.struct(
            *[F.when((p == q) & (end > acc[f"m{q}"]), end).otherwise(acc[f"m{q}"]).alias(f"m{q}") for q in range(4)],
            F.when(kept & ~F.array_contains(acc["labels"], x["label"]), F.concat(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(kept, F.greatest(acc["best"], p)).otherwise(acc["best"]).alias("best"),
        )

    return F.aggregate(found, start, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["best"].alias("best")))


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score."""
    keep, table = keep or {}, rules()
    every = sorted({w for names in gate_words(table).values() for w in names})  # the base phrases' words are among them
    rows = docs.select(*[F.col(c).alias(n) for c, n in keep.items()], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # The engine's own lower-casing is fast and, for words of ASCII letters, finds all that the contract's does.
    rows = rows.withColumn("_split", F.split(F.lower("_text"), NO_WORD))
    n = F.size("_split")
    ends = F.when(F.col("_split")[0] == "", 1).otherwise(0) + F.when((n > 1) & (F.element_at("_split", -1) == ""), 1).otherwise(0)
    rows = rows.select(*keep.values(), "_text", (n - ends).cast("long").alias("n_words"), F.when(F.arrays_overlap(F.array(*map(F.lit, every)), "_split"), F.array_intersect(F.array(*map(F.lit, every)), "_split")).alias("_held"))
    # only texts that hold a gate word are put into words again, exactly
    rows = rows.withColumn("_low", F.when(F.col("_held").isNotNull(), F.translate(words_of(F.col("_text")), UPPER, LOWER)))
    low = F.col("_low")
    rows = rows.withColumn("_hit", F.when(low.isNotNull(), hit_keywords(low, F.col("_held"), table)))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    base = F.array(*[F.when(F.contains(low, F.lit(f" {phrase} ")), base_places(low, phrase)).otherwise(none) for phrase, _ in BASE])
    rows = rows.withColumns({"_base": F.when(low.isNotNull(), base), "_found": F.when(F.size("_hit") > 0, unsuppressed(detections(low, F.col("_hit"), table)))})
    base = F.col("_base")
    names = F.array(*[F.lit(label) for _, label in BASE])
    base_labels = F.coalesce(F.filter(names, lambda x, i: base[i]["n"] > 0), F.array().cast("array<string>"))
    labels = F.array_union(base_labels, F.coalesce(F.col("_found.labels"), F.array().cast("array<string>")))
    confidence = F.lit(0.0)
    for p, c in CONFIDENCE.items():
        confidence = F.when(F.col("_found.best") == p, c).otherwise(confidence)
    return rows.select(
        *keep.values(), "n_words",
        F.coalesce(F.aggregate(base, F.lit(0).cast("long"), lambda acc, x: acc + x["n"]), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(confidence, F.when(F.size(base_labels) > 0, F.lit(BASE_CONFIDENCE)).otherwise(0.0)).alias("score"),
    )


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", {"doc_id": "doc_id"})


def _rules_sql() -> str:
    """The rules as SQL rows. The text's words stand between two blanks there, one of its own on either
    side, so that no pattern has to look ahead."""
    wide = lambda p: p.replace(" ?", "(?:\0)?").replace(" ", "  ").replace("\0", "  ")
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quoted(wide(p))}, {n}, {quoted(x)})" for _, p, n, x in dict.fromkeys(rules()))


OP9_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
j AS (SELECT r, ' ' || array_to_string(w, '  ') || ' ' AS j FROM d),
base(phrase, label) AS (VALUES (['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')),
places AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS i FROM d, base WHERE list_contains(w, phrase[1])),
b AS (SELECT r, count(*) AS n, min(i) AS first, max(i) AS last, list_distinct(list(label)) AS labels FROM places GROUP BY r),
rules(pattern, rank, label) AS (VALUES """
    + _rules_sql()
    + r"""),
m AS (SELECT r, rank, label, list_filter(string_split(regexp_replace(j, ' (' || pattern || ') ', ' ' || chr(1) || '\1' || chr(2) || ' ', 'g'), ' '), lambda x: x <> '') AS t
      FROM j JOIN rules ON regexp_matches(j, ' (?:' || pattern || ') ')),
f AS (SELECT row_number() OVER () AS k, * FROM (SELECT r, rank, label, unnest(list_filter(range(len(t)), lambda i: starts_with(t[i + 1], chr(1)))) AS s, unnest(list_filter(range(len(t)), lambda i: ends_with(t[i + 1], chr(2)))) AS e FROM m)),
kept AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.r = f.r AND g.rank > f.rank AND g.s <= f.s AND g.e >= f.e)),
x AS (SELECT r, max(rank) AS best, list(label) AS labels FROM kept GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(x.labels, []))), ','), '') AS labels,
       greatest(CASE best WHEN 3 THEN 1.0 WHEN 2 THEN 0.9 WHEN 1 THEN 0.7 WHEN 0 THEN 0.4 ELSE 0.0 END, CASE WHEN n > 0 THEN 0.9 ELSE 0.0 END)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN x USING (r)
"""
)

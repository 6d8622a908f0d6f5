"""Licence scans by canonical digests (operator 2), with DataFrame functions only.

A text is brought to a canonical form: A-Z in lower case; copyright lines dropped; `&` as "and"; everything else
that is no digit, letter or character beyond ASCII, and typographic marks, as one space; equivalent spellings
alike. The SHA-256 of that form of the entire text is joined by hash with the digests of known licences. A list
of up to `most_sent` digests is broadcast, a longer one shuffled.

A copyright line begins with "copyright" and goes on with a sign, a bracket, a year or "by", or has a year later
in the line; or it begins with "(c)" and has a year; or it begins with the sign or
"all rights reserved". Lines of sentences about copyright ("copyright notice and this permission ...") stay, so a licence has one
digest however its lines are wrapped.

Documents that carry a licence's one-line notice among other text are no licence texts. Their notices are found
in the same way, line by line: the digest of a line's canonical form is looked up among those of the few given
notices. Only texts whose canonical form contains a notice are cut into lines.

Map-only beside the join: nothing is grouped, so copies of one text can't gather in a task.

Defined results: a null text counts as empty; texts without a letter or digit have the digest of the empty
string and no licence; `notices` is null without any; repeated rows give repeated results; a digest listed twice
counts with its least name; other columns are ignored; texts may be of any length.
"""

from __future__ import annotations

import re
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.llm.common import ascii_lower, lower_col, table
from polyad.llm.licence_texts import FILES, NOTICES, TEXTS

NOTICE = r"\n[^a-z0-9\n]*(copyright[ \t]*(\(c\)|[©:<\[{0-9]|by )[^\n]*|(copyright|\(c\))[^\n]*(19|20)[0-9][0-9][^\n]*|©[^\n]*|all rights reserved[^\n]*)"
BREAK = r"([^0-9a-z\x{80}-\x{10FFFF}]|[‘’“”„«»–—…•·©®™])+"
#: Applied in this order to the spaced text.
SPELLINGS = [
    ("licenc", "licens"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("isation", "ization"), ("authoris", "authoriz"), ("organis", "organiz"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("initialis", "initializ"),
    ("favour", "favor"), ("honour", "honor"), ("behaviour", "behavior"), ("colour", "color"), ("centre", "center"), ("cancelled", "canceled"),
    ("labelled", "labeled"), ("fulfill", "fulfil"), ("judgement", "judgment"), ("merchantib", "merchantab"), ("programme", "program"),
    ("non commercial", "noncommercial"), ("sub licens", "sublicens"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
    ("https", "http"), ("whilst", "while"), ("wilful", "willful"),
]

#: Digests of canonical texts that are too long to be listed.
LONG: list[tuple[str, str]] = [
    ("036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b", "Apache-2.0"),
    ("f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe", "Apache-2.0"),
    ("e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2", "Artistic"),
    ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "CC0-1.0"),
    ("15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b", "GFDL-1.2"),
    ("2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d", "GFDL-1.3"),
    ("98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6", "GPL-1"),
    ("6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "GPL-1"),
    ("e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1", "GPL-2"),
    ("e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", "GPL-2"),
    ("0a85ab25a52f42a58c2cc4bf76b4808eb5d0505467f60ad614ac4d676f443478", "GPL-3"),
    ("7d75204ed685fd08ff55e7de654cd69da831b4d875c3d2c2e69d04d738cccc3e", "GPL-3"),
    ("e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d", "LGPL-2"),
    ("504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", "LGPL-2"),
    ("d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f", "LGPL-2.1"),
    ("48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", "LGPL-2.1"),
    ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "LGPL-3"),
    ("05fd37aae09cd94f2d2392e7b50352bf7c9f06cc262e760f81f6153822ae7073", "MPL-1.1"),
    ("6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d", "MPL-2.0"),
]


def canonical(text: Column) -> Column:
    noticed = F.regexp_replace(F.concat(F.lit("\n"), lower_col(F.coalesce(text, F.lit("")))), NOTICE, "\n")
    out = F.trim(F.regexp_replace(F.replace(noticed, F.lit("&"), F.lit(" and ")), BREAK, " "))
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return out


def canonical_text(text: str | None) -> str:
    """The same in Python, to make digests of new licences."""
    noticed = re.sub(NOTICE, "\n", "\n" + ascii_lower(text or "")).replace("&", " and ")
    out = re.sub(BREAK.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff"), " ", noticed).strip(" ")
    for one, other in SPELLINGS:
        out = out.replace(one, other)
    return out


def digest(text: str | None) -> str:
    return sha256(canonical_text(text).encode()).hexdigest()


def known_digests() -> list[tuple[str, str]]:
    """`(digest, name)` of all listed texts, with and without their titles, and notices."""
    out = {d: name for d, name in LONG}
    for name, titles, text in TEXTS:
        out |= {digest(f"{title}\n\n{text}"): name for title in titles} | {digest(text): name}
    out |= {digest(line): name for name, line in NOTICES}
    return sorted(out.items())


def digests_of(folder: str, names: list[str] = FILES) -> list[tuple[str, str]]:
    """`(digest, name)` of the licences in a folder, whole and without what follows their terms: how LONG was made."""
    import os

    out = []
    for name in names:
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as file:
                text = file.read()
            out.append((digest(text), name))
            head, end, _ = text.partition("END OF TERMS AND CONDITIONS")
            if end:
                out.append((digest(head + end), name))
    return out


def found_notices(text: Column, form: Column, notices: list[tuple[str, str]]) -> Column:
    """Names of the notices that are lines of the text, in order and separated by commas; `form`: the canonical text."""
    forms = sorted({canonical_text(line) for _, line in notices})
    if not forms:
        return F.lit(None).cast("string")
    names = F.create_map(*[F.lit(x) for pair in {digest(line): name for name, line in notices}.items() for x in pair])
    maybe = form.contains(forms[0])
    for f in forms[1:]:
        maybe = maybe | form.contains(f)
    lines = F.transform(F.split(text, "\n"), lambda line: F.try_element_at(names, F.sha2(canonical(line).cast("binary"), 256)))
    found = F.array_sort(F.array_distinct(F.filter(lines, lambda x: x.isNotNull())))
    return F.when(maybe, F.nullif(F.array_join(found, ", "), F.lit("")))


def scan(docs: DataFrame, known: list[tuple[str, str]] | DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most_sent: int = 100_000, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """`(doc_id, canonical_chars, digest, licence, notices)` for every row; known: (digest, licence), notices: (name, line)."""
    spark = docs.sparkSession
    if not isinstance(known, DataFrame):
        known = spark.createDataFrame(known if known is not None else known_digests(), "digest string, licence string")
    listed = known.groupBy("digest").agg(F.min("licence").alias("licence"))
    if known.count() <= most_sent:
        listed = F.broadcast(listed)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    forms = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).select("doc_id", "text", canonical(F.col("text")).alias("form"))
    marked = forms.select("doc_id", F.char_length("form").cast("bigint").alias("canonical_chars"), F.sha2(F.col("form").cast("binary"), 256).alias("digest"), found_notices(F.col("text"), F.col("form"), notices).alias("notices"))
    return marked.join(listed, "digest", "left").select("doc_id", "canonical_chars", "digest", "licence", "notices")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _form_sql(text: str) -> str:
    form = f"'\n' || translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    form = f"replace(regexp_replace({form}, {_quoted(NOTICE)}, '\n', 'g'), '&', ' and ')"
    form = f"trim(regexp_replace({form}, {_quoted(BREAK)}, ' ', 'g'), ' ')"
    for one, other in SPELLINGS:
        form = f"replace({form}, {_quoted(one)}, {_quoted(other)})"
    return form


def oracle() -> str:
    rows = ", ".join(f"({_quoted(d)}, {_quoted(n)})" for d, n in known_digests())
    lines = sorted({digest(line): name for name, line in NOTICES}.items())
    digests, names = (", ".join(_quoted(x[i]) for x in lines) for i in (0, 1))
    named = f"[list_extract([{names}], list_position([{digests}], sha256({_form_sql('x')}))) FOR x IN string_split(text, chr(10))]"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), forms AS MATERIALIZED (SELECT doc_id, text, {_form_sql('text')} AS form FROM docs),
lined AS MATERIALIZED (SELECT doc_id, form, CASE WHEN regexp_matches(form, 'licens') THEN nullif(array_to_string(list_sort(list_distinct([y FOR y IN {named} IF y IS NOT NULL])), ', '), '') END AS notices FROM forms),
known(digest, licence) AS (VALUES {rows})
SELECT doc_id, length(form) AS canonical_chars, sha256(form) AS digest, licence, notices FROM lined LEFT JOIN known ON sha256(form) = known.digest"""

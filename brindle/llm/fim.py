"""Fill-in-middle by markers put into the text, with column functions only.

A delimiter is escaped, so that the text holds none; one regular expression then puts it after every unit, so units are
counted by counting it and cut by rank with substring_index; the parts drop the delimiters and are unescaped. A text is
never exploded into rows, so nothing is shuffled and the longest text costs its own length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit of the contract: a word with the white space before it, or white space that ends the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Delimiter and escape: characters that are no white space, so that escaping changes no unit.
MARK, ESCAPE = "\x02", "\x01"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escaped(text: Column) -> Column:
    """text without MARK: ESCAPE becomes `ESCAPE e`, MARK `ESCAPE d`."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARK), F.lit(ESCAPE + "d"))


def unescaped(part: Column) -> Column:
    """A part of an escaped text without the MARKs put in and as it was; `ESCAPE e` goes last, as it gives ESCAPEs."""
    plain = F.replace(F.replace(part, F.lit(MARK), F.lit("")), F.lit(ESCAPE + "d"), F.lit(MARK))
    return F.replace(plain, F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def first_parts(text: Column, k: Column, mark: Column | str = MARK) -> Column:
    """What stands before the k-th mark (k = 0: nothing)."""
    return F.call_function("substring_index", text, F.lit(mark) if isinstance(mark, str) else mark, k.cast("int"))


def last_parts(text: Column, k: Column, mark: str = MARK) -> Column:
    """What stands after the k-th mark from the end (k = 0: nothing; fewer marks: all)."""
    return F.call_function("substring_index", text, F.lit(mark), (-k).cast("int"))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of `seed:doc_id`; a null id counts as an empty one."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fim() came from. Markers begin with a character that stands nowhere else in them, so none can
    arise where a part and a marker meet, and plain texts alone hold any of their own."""
    after = F.substring(output, len(PREFIX) + 1, 1 << 30)
    middle = last_parts(output, F.lit(1), MIDDLE)
    front = F.call_function("substring_index", output, F.lit(MIDDLE), F.lit(1))
    psm = F.concat(F.call_function("substring_index", after, F.lit(SUFFIX), F.lit(1)), middle, last_parts(front, F.lit(1), SUFFIX))
    spm = F.concat(last_parts(front, F.lit(1), PREFIX), middle, F.call_function("substring_index", after, F.lit(PREFIX), F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs with text as `output` and n, form, prefix_chars, middle_chars: of rate % of the texts a middle of whole units, cut by draws
    from (seed, doc_id), stands last; of these spm % have the suffix first. Empty texts and those that hold a marker stay plain.

    A null text counts as empty, a null doc_id as an empty one; rows that repeat a doc_id and text come out alike; an empty table
    gives no rows. Other columns pass through; those named output, n, form, prefix_chars and middle_chars are replaced."""
    own = ["output", "n", "form", "prefix_chars", "middle_chars"]
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", *own)]).alias("__rest")
    h = draws(F.col("doc_id"), seed)
    x = docs.select(rest, F.coalesce("text", F.lit("")).alias("__text"), *[v.alias(f"__h{i}") for i, v in enumerate(h)])
    x = x.select("*", F.regexp_replace(escaped(F.col("__text")), UNIT, "$0" + MARK).alias("__marked"))
    x = x.select("*", (F.length("__marked") - F.length(F.replace("__marked", F.lit(MARK), F.lit("")))).alias("__n"))
    a, b = F.col("__h0") % (F.col("__n") + 1), F.col("__h1") % (F.col("__n") + 1)
    holds = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains("__text", F.lit(m))
    form = F.when((F.col("__text") == "") | holds | (F.col("__h2") % 100 >= rate), "plain").when(F.col("__h3") % 100 < spm, "spm").otherwise("psm")
    x = x.select("__rest", "__text", "__marked", "__n", F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b"), form.alias("__form"))
    # parts only where they are used: a plain text is not cut
    cut = lambda part: F.when(F.col("__form") != "plain", unescaped(part))
    upto = first_parts(F.col("__marked"), F.col("__b"))
    x = x.select("__rest", "__text", "__n", "__form", cut(first_parts(F.col("__marked"), F.col("__a"))).alias("__p"), cut(last_parts(upto, F.col("__b") - F.col("__a"))).alias("__m"), cut(last_parts(F.col("__marked"), F.col("__n") - F.col("__b") + 1)).alias("__s"))
    p, m, s = (F.col(f"__{c}") for c in "pms")
    psm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)
    turned = F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    output = F.when(F.col("__form") == "psm", psm).when(F.col("__form") == "spm", turned).otherwise(F.col("__text"))
    return x.select("__rest.*", output.alias("output"), F.col("__n").cast("long").alias("n"), F.col("__form").alias("form"), F.length(p).alias("prefix_chars"), F.length(m).alias("middle_chars"))


def op11(docs: DataFrame) -> DataFrame:
    """Every document's form, sizes and digests of its output and of the text rebuilt from that. Null texts are empty; see fim()."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = fim(docs.select("doc_id", "text"))
    return out.select("doc_id", "n", "form", F.col("prefix_chars").cast("long").alias("prefix_chars"), F.col("middle_chars").cast("long").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same by lists of units.
SQL = r"""
with u as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units, sha256('42:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (select doc_id, text, units, len(units)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from u),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select doc_id, text, n, form, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m, array_to_string(units[b + 1:], '') as s from c)
select doc_id, n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars, case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else text end) as output_sha256, sha256(text) as restored_sha256 from p"""

"""Fill-in-middle: a text's units are cut in two places and given in another order between sentinels.

All of it is Spark SQL.  ``regexp_extract_all`` makes the unit array in two
levels: blocks of up to ``BLOCK`` units (a possessive run of the unit pattern,
so each unit is matched as it would be alone, left to right), and the units of
the blocks that a cut falls in.  A row so takes a few times its text and two
blocks' units, not some eighty bytes for each character of it.  Slices of
blocks and units, joined, are prefix, middle and suffix.  Cuts come from a
document's id alone (the first 8-digit groups of a sha256), so a task that is
run again gives the same rows.  No shuffle.

Results at the edges: a null text counts as an empty one, which stays plain;
a null id is hashed as an empty one; equal ids get equal cuts if their texts
have equally many units; repeated rows are returned as often as they come;
texts are taken whole whatever their length; other columns stay, but those
named as the results are replaced; an empty table gives no rows.  A text that
holds a sentinel, or that the unit pattern doesn't cover, stays plain.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix, suffix and middle follow these.
SENTINELS = ("<P>", "<S>", "<M>")
#: One code point.
CHARACTER = "(?s)."
#: Units of a block.
BLOCK = 1024


def draws(doc_id: str, seed: str, n: int = 4) -> list[Column]:
    """The first ``n`` 8-digit groups of the hex sha256 of ``seed:doc_id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)]


def arranged(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = CHARACTER, percent: int = 90, spm_percent: int = 20, seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS, block: int = BLOCK
) -> DataFrame:
    """``df`` with n (units), form (plain, psm, spm), prefix_units and middle_units (null if plain) and output.

    ``percent`` of the documents are rearranged, ``spm_percent`` of these with
    the suffix first.  ``unit`` is a pattern without an empty match, by default
    one code point; ``\\\\s*\\\\S+\\\\s*`` would cut between words.
    """
    checked(sentinels)
    results = ("n", "form", "prefix_units", "middle_units", "output")
    p, s, m = (F.lit(x) for x in sentinels)

    def units(part: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(part, F.lit("")), F.lit(unit), F.lit(0))

    def joined(array: Column, start: Column | int, length: Column | int) -> Column:
        return F.array_join(F.slice(array, start, length), "")

    h1, h2, h3, h4 = (F.col(f"__fim_h{k}") for k in (1, 2, 3, 4))
    t, blocks, n = F.col("__fim_text"), F.col("__fim_blocks"), F.col("__fim_n")
    rows = df.withColumns({"__fim_text": F.coalesce(F.col(text), F.lit(""))} | {f"__fim_h{k + 1}": h for k, h in enumerate(draws(doc_id, seed))})
    rows = rows.withColumn("__fim_blocks", F.regexp_extract_all(t, F.lit(f"(?:{unit}){{1,{block}}}+"), F.lit(0)))
    rows = rows.withColumn("__fim_n", F.when(F.size(blocks) == 0, F.lit(0)).otherwise((F.size(blocks) - 1) * block + F.size(units(F.element_at(blocks, -1)))).cast("long"))
    rows = rows.withColumns({"__fim_a": F.least(h1 % (n + 1), h2 % (n + 1)), "__fim_b": F.greatest(h1 % (n + 1), h2 % (n + 1))})
    a, b = F.col("__fim_a"), F.col("__fim_b")
    block_a, block_b, in_a, in_b = ((a / block).cast("int"), (b / block).cast("int"), (a % block).cast("int"), (b % block).cast("int"))
    ua, ub = F.col("__fim_ua"), F.col("__fim_ub")
    rows = rows.withColumns({"__fim_ua": units(F.get(blocks, block_a)), "__fim_ub": units(F.get(blocks, block_b))})
    across = F.concat(joined(ua, in_a + 1, F.lit(block)), joined(blocks, block_a + 2, block_b - block_a - 1), joined(ub, 1, in_b))
    plain = (t == "") | (h3 % 100 >= percent) | (F.array_join(blocks, "") != t)
    for x in (p, s, m):
        plain = plain | F.contains(t, x)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns(
        {
            "__fim_form": form,
            "__fim_prefix": F.concat(joined(blocks, 1, block_a), joined(ua, 1, in_a)),
            "__fim_middle": F.when(block_a == block_b, joined(ua, in_a + 1, F.greatest(in_b - in_a, F.lit(0)))).otherwise(across),
            "__fim_suffix": F.concat(joined(ub, in_b + 1, F.lit(block)), joined(blocks, block_b + 2, F.size(blocks))),
        }
    )
    kind, prefix, middle, suffix = (F.col(f"__fim_{x}") for x in ("form", "prefix", "middle", "suffix"))
    output = F.when(kind == "plain", t).when(kind == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    cut = kind != "plain"
    return rows.select(
        *(c for c in df.columns if c not in results),
        n.alias("n"),
        kind.alias("form"),
        F.when(cut, a).alias("prefix_units"),
        F.when(cut, b - a).alias("middle_units"),
        output.alias("output"),
    )


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, from the output and its form alone: what stands between the sentinels, in the old order."""
    parts = F.split(F.col(output), "|".join(map(re.escape, checked(sentinels))), -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", psm).otherwise(spm)


def checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """``sentinels``, if each can be found again between any texts without one: different, and begun by a mark that stands nowhere else in any."""
    if len(set(sentinels)) != 3 or not all(sentinels) or any(x[0] in y[1:] for x in sentinels for y in sentinels) or any(x != y and y.startswith(x) for x in sentinels for y in sentinels):
        raise ValueError(f"sentinels can't be told apart from texts: {sentinels}")
    return sentinels

"""License scans: exact phrases, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_text, written

#: Share of a template's distinct words that a block must hold; a template of up to SHORT distinct words must be held whole,
#: or a notice of one license would pass for another's that differs in its name only.
CONTAINMENT, SHORT = 0.8, 10
#: Words from one block's start to the next, for short templates; for longer ones a power of two times as many.
STEP = 32

# The base phrases with their labels, and notices of well-known licenses with theirs.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
TEMPLATES = [
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any "
        "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
        "even if advised of the possibility of such damage",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product "
        "an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "this notice may not be removed or altered from any source distribution",
    ),
]

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text, lower-cased in ASCII, with one space before the first and after each; '  ' without words."""
    words = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _NOT_WORD, " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def base_columns(s: str, phrases: list[tuple[str, str]]) -> list[Column]:
    """n_words, n_base, first_word, last_word, base_labels from the spaced words in column s."""
    words = F.col(s)
    n_words = F.when(words == "  ", 0).otherwise(_spaces(words) - 1)
    counts, firsts, lasts, names = [], [], [], []
    for phrase, label in phrases:
        size, padded = len(phrase.split()), f" {phrase} "
        there = words.contains(padded)
        own = "".join(f" {w} " for w in phrase.split())
        doubled = F.replace(words, F.lit(" "), F.lit("  "))
        counts.append(F.when(there, ((F.length(doubled) - F.length(F.replace(doubled, F.lit(own), F.lit("")))) / len(own)).cast("long")).otherwise(F.lit(0)))
        firsts.append(F.when(there, _spaces(F.substring_index(words, padded, 1))))
        lasts.append(F.when(there, _spaces(words) - 1 - _spaces(F.substring_index(words, padded, -1)) - size))
        names.append(F.when(there, F.lit(label)))
    labels = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))), ",")
    one = len(phrases) == 1
    return [
        n_words.cast("long").alias("n_words"),
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        (firsts[0] if one else F.least(*firsts)).cast("long").alias("first_word"),
        (lasts[0] if one else F.greatest(*lasts)).cast("long").alias("last_word"),
        labels.alias("base_labels"),
    ]


def template_order(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words, rarest first by the number of rows that hold them (in `held`), ties by the word; the counts have a row per template word."""
    counts = {r["word"]: r["count"] for r in rows.select(F.explode("held").alias("word")).groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def needed(words: int) -> int:
    """How many of a template's distinct words a block must hold."""
    return words if words <= SHORT else math.ceil(CONTAINMENT * words - 1e-9)


def step_for(template: str) -> int:
    """Words from one block's start to the next, the least STEP * 2^i that holds the template; blocks are twice as long, so it lies whole in one."""
    step = STEP
    while step < len(template.split()):
        step *= 2
    return step


def _words(words: list[str]) -> Column:
    """An array literal, as one expression: a call for each word would take seconds for whole license texts."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.expr(f"array({quoted})") if words else F.array().cast("array<string>")


def _share(template: Column, block: Column) -> Column:
    """The containment of a template in a block's set of words, both in the global order; null where a filter or the threshold rules it out.

    Prefix filter: to reach the overlap n, a block must hold one of the template's first |T| - n + 1 words.
    Length filter: it holds at least n template words. Positional filter: before the first word they share
    nothing is shared, so what stands from it on, on either side, must be n words. Survivors are verified.
    """
    words, need = template["words"], template["need"]
    first = F.get(F.array_intersect(template["prefix"], block), 0)
    left = F.least(F.size(words) - F.array_position(words, first), F.size(block) - F.array_position(block, first)) + 1
    common = F.when((F.size(block) >= need) & (left >= need), F.size(F.array_intersect(words, block)))
    return F.when(common >= need, common / F.size(words))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks array<struct<label, start, share>>.

    Blocks are the stretches of words, by their start, that hold enough of a template's distinct words: all of a
    short one's, CONTAINMENT of others'. Words are ordered by global frequency, rarest first. The templates are
    a fixed list, so a row is joined with all of them where it is: nothing is shuffled or exploded. Filters
    only skip what can't reach the threshold, so no block is missed. score is 1 for a base phrase, else the
    largest share found (0 below the threshold). Null text counts as empty; repeated rows stay rows; empty
    docs give no rows; other columns are not read. The words of each text, and which of the templates' they are,
    are found once and written: the frequencies come from this table, and the scan reads it again.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    rows = docs.select(F.col(key).alias("doc_id"), spaced(plain_text(F.col(text))).alias("s"))
    rows = rows.withColumn("held", F.array_intersect(_words(vocabulary), F.split("s", " ")))
    rows = written(rows, "license-words")
    order = template_order(rows, vocabulary)
    place = {w: i for i, w in enumerate(order)}
    by_step: dict[int, list[Column]] = {}
    prefixes, least = set(), len(order)
    for label, template in templates:
        words = sorted(set(template.split()), key=place.get)
        need = needed(len(words))
        prefix = words[: len(words) - need + 1]
        prefixes |= set(prefix)
        least = min(least, need)
        one = F.struct(F.lit(label).alias("label"), _words(words).alias("words"), _words(prefix).alias("prefix"), F.lit(need).alias("need"))
        by_step.setdefault(step_for(template), []).append(one)

    likely = (F.size("held") >= least) & F.arrays_overlap("held", _words(sorted(prefixes)))
    rows = rows.select("doc_id", *base_columns("s", phrases), F.when(likely, F.split(F.trim("s"), " ")).alias("words"), F.when(likely, F.array_intersect(_words(order), "held")).alias("held"))

    def found(step: int, some: list[Column]) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(step))
        blocks = F.transform(starts, lambda at: F.struct(at.alias("at"), F.array_intersect("held", F.slice("words", at, 2 * step)).alias("set")))
        blocks = F.filter(blocks, lambda b: F.size(b["set"]) >= least)

        def of(template: Column) -> Column:
            marked = F.transform(blocks, lambda b: F.struct(template["label"].alias("label"), (b["at"] - 1).cast("long").alias("start"), _share(template, b["set"]).alias("share")))
            return F.filter(marked, lambda x: x["share"].isNotNull())

        return F.flatten(F.transform(F.array(*some), of))

    kind = "array<struct<label: string, start: bigint, share: double>>"
    blocks = F.concat(*[found(step, some).cast(kind) for step, some in sorted(by_step.items())]) if by_step else F.array().cast(kind)
    rows = rows.withColumn("blocks", F.when(F.col("words").isNotNull(), blocks).otherwise(F.array().cast(kind)))
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    return rows.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_join(F.array_sort(F.array_union(base, F.col("blocks.label"))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.share"), F.lit(0.0))).alias("score"),
        "blocks",
    )

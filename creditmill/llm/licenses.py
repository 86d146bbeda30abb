"""Licence recognition from sentences: known sentences get identifiers, ordered rules match identifier sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditmill.llm.common import settled, text_of
from creditmill.llm.spans import with_matches

#: identifier: sentences of licences and notices (fixed values, compared after normalising).
SENTENCES = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.",
                   "This project is licensed under the MIT License."],
    "mit-title": ["The MIT License (MIT)", "MIT License"],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-include": ["The above copyright notice and this permission notice shall be included in all copies or "
                    "substantial portions of the Software."],
    "mit-as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit-liable": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "apache-notice": ["Licensed under the Apache License, Version 2.0.",
                      "Licensed under the Apache License, Version 2.0 (the \"License\");",
                      "Released under the Apache License, Version 2.0."],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-obtain": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.",
                    "This program is licensed under the GNU General Public License, version 3."],
    "gpl-redistribute": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-redistribute": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-free": ["This program is free software:"],
    "ccbync-notice": ["Licensed under CC BY-NC 4.0.",
                      "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "ccby-notice": ["Licensed under CC BY 4.0.",
                    "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                  "provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and "
                   "the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
                   "and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                    "or promote products derived from this software without specific prior written permission."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                  "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "reserved": ["All rights reserved."],
}
#: licence: sequences of identifiers, other sentences may stand between them.
RULES = {
    "MIT": [["mit-title", "mit-grant", "mit-include", "mit-as-is", "mit-liable"],
            ["mit-grant", "mit-include", "mit-as-is", "mit-liable"], ["mit-notice"], ["mit-grant", "mit-include"]],
    "Apache-2.0": [["apache-notice", "apache-comply", "apache-obtain"], ["apache-notice", "apache-comply"], ["apache-notice"]],
    "GPL-3.0-or-later": [["gpl-free", "gpl-redistribute"]],
    "GPL-2.0-or-later": [["gpl-free", "gpl2-redistribute"]],
    "GPL-3.0": [["gpl3-notice"]],
    "CC-BY-NC-4.0": [["ccbync-notice"]],
    "CC-BY-4.0": [["ccby-notice"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "ISC": [["isc-grant"]],
    "MPL-2.0": [["mpl-notice"]],
    "LicenseRef-All-Rights-Reserved": [["reserved"]],
}
#: A notice that may stand between the sentences of a rule, or before a grant, and then says nothing of its own.
ASIDE = "reserved"
#: A sentence ends after these marks before a blank, or at an empty line; in the finer cut also at the end of a line.
#: The runs give nothing back (++), so that matching a very long sentence takes no stack.
COARSE = r"(?s)(?:(?![.!?;:]\s|\n[ \t]*\n).)++(?:[.!?;:](?=\s))?"
FINE = r"(?:(?![.!?;:]\s)[^\n])++(?:[.!?;:](?=\s))?"


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def _normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def _parts(sentence: str) -> tuple[str, ...]:
    """What a text that holds the sentence is cut into; a mark inside, as in "v. 2.0", cuts it."""
    return tuple(normalised(part) for part in re.findall(COARSE, sentence))


def _words() -> list[str]:
    """Words of which every known sentence has one: those that most sentences have first, then the longer ones."""
    left = {normalised(s) for sentences in SENTENCES.values() for s in sentences}
    chosen = []
    while left:
        words = {w for s in left for w in s.split()}
        chosen.append(min(words, key=lambda w: (len(w) < 7, -sum(w in s for s in left), -len(w), w)))
        left = {s for s in left if chosen[-1] not in s}
    return chosen


_CODES = {name: chr(0x3400 + k) for k, name in enumerate(SENTENCES)}
_PART_CODES = {part: chr(0x4E00 + k) for k, part in enumerate(dict.fromkeys(
    part for sentences in SENTENCES.values() for s in sentences for part in _parts(s)))}
#: codes of the parts of a sentence, joined by +: its identifier's code.
_WHOLE = {"+".join(_PART_CODES[p] for p in _parts(s)): _CODES[name] for name, sentences in SENTENCES.items() for s in sentences}


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _with_sentences(df: DataFrame, name: str, pattern: str, apart: int) -> DataFrame:
    """Adds ``name``: the known sentences (start, end, code) in the cut by ``pattern``.

    The parts of a sentence count only together and with nothing but blanks between; ``apart`` is how many characters
    the cut leaves out where a sentence may go on.
    """
    parts, order, whole = (f"{name}_{n}" for n in ("parts", "order", "whole"))
    df = with_matches(df, "t", pattern, name)
    df = df.withColumn(parts, F.filter(F.transform(name, lambda x, i: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), i.alias("i"),
        F.try_element_at(_map(_PART_CODES), _normalised(x["hit"])).alias("code"))), lambda x: x["code"].isNotNull()))
    # from: where the part starts with its blanks, which may be a piece of their own
    blanks, blank_piece = "(length(p.hit) - length(ltrim(' \\t\\n\\r', p.hit)))", f"get({name}, p.i - 1)"
    df = df.withColumn(parts, F.expr(
        f"transform({parts}, p -> struct(p.start + {blanks} AS start, p.end AS end, p.code AS code,"
        f" IF(ltrim(' \\t\\n\\r', {blank_piece}.hit) = '', p.start - length({blank_piece}.hit), p.start) AS from))"))
    df = df.withColumn(order, F.expr(
        f"array_join(transform({parts}, (p, i) -> concat("
        f"IF(p.from - get({parts}, i - 1).end <= {apart}, '+', ' '), p.code)), '')"))
    longest_first = sorted(_WHOLE, key=len, reverse=True)
    df = with_matches(df, order, "|".join("[ +]" + w.replace("+", "[+]") for w in longest_first), whole)
    # two characters a part
    df = df.withColumn(whole, F.expr(
        f"transform({whole}, w -> struct(get({parts}, w.start DIV 2).start AS start,"
        f" get({parts}, w.end DIV 2 - 1).end AS end, substring(w.hit, 2) AS code))"))
    return df.withColumn(name, F.transform(whole, lambda w: F.struct(
        w["start"].alias("start"), w["end"].alias("end"), F.element_at(_map(_WHOLE), w["code"]).alias("code")))
    ).drop(parts, order, whole)


def recognise(docs: DataFrame) -> DataFrame:
    """doc_id, known (array of start, end, code), found (array of licence, start, end); one row per input row.

    Places are code points, end exclusive. A sentence counts in the cut at marks, which sees through line breaks, or
    else in the cut at marks and line ends. Of the rules that match at a sentence the longest counts, and its sentences
    are used up; "All rights reserved." between them, or last before a grant, is not a finding of its own. Texts that are missing, empty or without known sentence give empty arrays; repeated rows are each
    scanned; an empty table gives no rows.
    """
    df = docs.select("doc_id", text_of().alias("t"))
    # texts without any of the words need no cutting
    df = df.withColumn("t", F.when(F.lower("t").rlike("|".join(_words())), F.col("t")).otherwise(""))
    df = _with_sentences(_with_sentences(df, "coarse", COARSE, 0), "fine", FINE, 1)
    df = df.select("doc_id", F.array_sort(F.concat("coarse", F.expr(
        "filter(fine, f -> NOT exists(coarse, c -> c.start < f.end AND f.start < c.end))"))).alias("known"))
    aside = _CODES[ASIDE]
    by_length = sorted(((len(seq), "".join(_CODES[s] for s in seq), licence, seq[0]) for licence, seqs in RULES.items()
                        for seq in seqs if seq != [ASIDE]), reverse=True)
    pattern = "|".join([(f"{aside}?" if first.endswith("-grant") else "") + f"{aside}*".join(seq)
                        for _, seq, _, first in by_length] + [aside])
    names = _map({seq: licence for _, seq, licence, _ in by_length} | {
        "": licence for licence, seqs in RULES.items() if [ASIDE] in seqs})
    df = df.withColumn("order", F.array_join(F.transform("known", lambda x: x["code"]), ""))
    df = with_matches(df, "order", pattern, "rule")
    # the place of a rule starts at its first sentence, not at a notice before it
    df = df.withColumn("rule", F.expr(
        f"transform(rule, r -> struct(r.start + IF(r.hit LIKE '{aside}_%', 1, 0) AS start, r.end AS end,"
        f" replace(r.hit, '{aside}', '') AS hit))"))
    found = F.transform("rule", lambda r: F.struct(
        F.element_at(names, r["hit"]).alias("licence"), F.col("known")[r["start"]]["start"].alias("start"),
        F.col("known")[r["end"] - 1]["end"].alias("end")))
    return settled(df, ["doc_id"], {"known": F.col("known"), "found": found})


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, licences (different ones by name, comma-joined), n_sentences, spans (licence:start:end by start)."""
    return recognise(docs).select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["licence"]))), ",").alias("licences"),
        F.size("known").cast("long").alias("n_sentences"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(
            ":", x["licence"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))

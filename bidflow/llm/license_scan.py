"""License scans by ordered signature rules, in DataFrame functions alone.

The text is reduced to lower-case words parted by single blanks. Hundreds of rules (names of
licenses in the phrasings that state a license) each have keywords, a regular expression and a
priority. A document first passes a keyword gate; a rule's expression runs only where one of its
own keywords, of which each of its alternatives holds one, stands in the document. Detections are
resolved in order of start, then length, then priority, then rule: one whose interval lies within
that of a detection before it is suppressed, so the more specific statement wins, and a denial (``not licensed under ...``) suppresses what
it denies.

Edge cases: a null or empty text has no words, no labels and score 0; a null id stays null;
repeated rows are scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.llm.common import read

# Phrases whose places are reported, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, keywords (parted by bars; each alternative of the name holds one), name as it reads in normalised words (a regular expression)
NAMES = [
    ("mit", "mit|expat", "(?:mit|expat)"),
    ("x11", "x11|x consortium", "(?:x11|mit x11|x consortium)"),
    ("apache-2", "apache", "apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?"),
    ("apache-1", "apache", "apache(?: software)?(?: licen[sc]e)?(?: version| v)? 1 [01]"),
    ("gpl-1", "gpl|gnu", "(?:gpl|gnu(?: general)?(?: public)?(?: licen[sc]e)?)(?: version| v)? ?1(?: 0)?"),
    ("gpl-2", "gpl|gnu", "(?:gpl|gplv|gnu(?: general)?(?: public)?(?: licen[sc]e)?)(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "gpl|gnu", "(?:gpl|gplv|gnu(?: general)?(?: public)?(?: licen[sc]e)?)(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2", "lgpl|gnu l", "(?:lgpl|lgplv|gnu (?:lesser|library)(?: general)?(?: public)?(?: licen[sc]e)?)(?: version| v)? ?2(?: [01])?"),
    ("lgpl-3", "lgpl|gnu lesser", "(?:lgpl|lgplv|gnu lesser(?: general)?(?: public)?(?: licen[sc]e)?)(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "agpl|gnu affero", "(?:agpl|agplv|gnu affero(?: general)?(?: public)?(?: licen[sc]e)?)(?: version| v)? ?3(?: 0)?"),
    ("gfdl", "gfdl|free documentation", "(?:gfdl|gnu free documentation)"),
    ("bsd-0", "bsd", "(?:0bsd|bsd 0 clause|zero clause bsd)"),
    ("bsd-2", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("isc", "isc", "isc"),
    ("mpl-1", "mpl|mozilla", "(?:mpl|mozilla public(?: licen[sc]e)?)(?: version| v)? ?1(?: [01])?"),
    ("mpl-2", "mpl|mozilla", "(?:mpl|mozilla public(?: licen[sc]e)?)(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "epl|eclipse", "(?:epl|eclipse public(?: licen[sc]e)?)(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "epl|eclipse", "(?:epl|eclipse public(?: licen[sc]e)?)(?: version| v)? ?2(?: 0)?"),
    ("eupl", "eupl|european union", "(?:eupl|european union public)"),
    ("cddl", "cddl", "cddl"),
    ("cpl-1", "common public", "common public"),
    ("unlicense", "unlicen", "unlicen[sc]e"),
    ("cc0", "cc0|cc zero|creative commons", "(?:cc0|cc zero|creative commons zero)"),
    ("cc-by-nc-nd", "cc by|creative commons", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)"),
    ("cc-by-nc-sa", "cc by|creative commons", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)"),
    ("cc-by-nc", "cc by|creative commons", "(?:cc by nc|creative commons attribution non ?commercial)"),
    ("cc-by-nd", "cc by|creative commons", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)"),
    ("cc-by-sa", "cc by|creative commons", "(?:cc by sa|creative commons attribution share ?alike)"),
    ("cc-by", "cc by|creative commons", "(?:cc by|creative commons attribution)"),
    ("artistic-1", "artistic", "artistic(?: licen[sc]e)?(?: version| v)? ?1(?: 0)?"),
    ("artistic-2", "artistic", "artistic(?: licen[sc]e)?(?: version| v)? ?2(?: 0)?"),
    ("boost-1", "bsl 1 0|boost", "(?:bsl 1 0|boost software)"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("wtfpl", "wtfpl|do what the fuck", "(?:wtfpl|do what the fuck you want to public)"),
    ("ofl-1", "ofl|open font", "(?:ofl|sil open font)(?: version| v)?(?: 1 1)?"),
    ("ms-pl", "ms pl|microsoft", "(?:ms pl|microsoft public)"),
    ("ms-rl", "ms rl|microsoft", "(?:ms rl|microsoft reciprocal)"),
    ("psf-2", "psf|python software", "(?:psf|python software foundation)"),
    ("postgresql", "postgresql", "postgresql"),
    ("openssl", "openssl", "openssl"),
    ("php-3", "php", "php(?: version| v)? ?3(?: 0[01]?)?"),
    ("ruby", "ruby", "ruby"),
    ("w3c", "w3c", "w3c(?: software)?(?: notice and)?"),
    ("afl-3", "afl|academic free", "(?:afl|academic free)"),
    ("osl-3", "osl|open software", "(?:osl|open software)"),
    ("cecill", "cecill", "cecill(?: [bc])?"),
    ("odbl", "odbl|open database", "(?:odbl|open database|odc open database)"),
    ("odc-by", "odc by|open data commons", "(?:odc by|open data commons attribution)"),
    ("pddl", "pddl|public domain dedication", "(?:pddl|public domain dedication and)"),
    ("ncsa", "ncsa", "(?:ncsa|university of illinois ncsa)"),
    ("ecl-2", "ecl|educational community", "(?:ecl|educational community)"),
    ("upl-1", "upl|universal permissive", "(?:upl|universal permissive)"),
    ("sleepycat", "sleepycat", "sleepycat"),
    ("vim", "vim", "vim"),
    ("qpl-1", "qpl|q public", "(?:qpl|q public)"),
    ("ipl-1", "ipl|ibm public", "(?:ipl|ibm public)"),
    ("apsl-2", "apsl|apple public", "(?:apsl|apple public source)"),
    ("llama", "llama", "llama(?: [234])?(?: community)?"),
    ("openrail", "openrail", "(?:bigscience |creativeml )?openrail(?: m)?"),
]
#: priority, what stands before the name, what stands after
PHRASINGS = [
    (95, "(?:not|never) (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?", "(?: licen[sc]e)?"),
    (90, "spdx licen[sc]e identifiers? ", "(?: only| or later)?"),
    (85, "(?:licen[sc]ed|released|distributed|published|available|provided|redistributed) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?", "(?: public| general public)?(?: licen[sc]e| international| unported)*"),
    (75, "under (?:the )?(?:terms of )?(?:the )?", "(?: public)? licen[sc]e"),
    (65, "(?:the )?", "(?: public)? licen[sc]e(?: agreement)?"),
]
#: Notices, headers and clauses by hand: label, keyword that every text of the rule holds, priority, text
OTHERS = [
    ("all-rights-reserved", "rights reserved", 60, "all rights reserved"),
    ("public-domain", "public domain", 60, "(?:released|placed|dedicated)(?: in)?to the public domain"),
    ("public-domain", "public domain", 60, "(?:this (?:file|work|code|software|program|text) )?is (?:hereby )?in the public domain"),
    ("mit", "permission is hereby granted", 80, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission notice", 78, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", 70, "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-0", "permission is hereby granted", 82, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("x11", "consortium shall not be used", 84, "the name of the x consortium shall not be used in advertising"),
    ("isc", "permission to use", 80, "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "permission to use", 79, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("bsd-0", "permission to use", 84, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("hpnd", "permission to use", 77, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd-3", "redistribution and use", 80, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2", "redistributions of source", 72, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2", "redistributions in binary", 72, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", "endorse or promote", 83, "neither the names? of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3", "endorse or promote", 82, "the names? of the (?:author|copyright holder|contributor)s? may not be used to endorse or promote products"),
    ("bsd-4", "advertising materials", 86, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clear", "express or implied licenses", 86, "no express or implied licenses to any party s patent rights are granted by this license"),
    ("apache-2", "licensed under the apache", 88, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "apache org", 76, "you may obtain a copy of the license at http s? ?www apache org licenses license 2 0"),
    ("apache-2", "apache org", 74, "www apache org licenses license 2 0"),
    ("apache-2", "applicable law", 62, "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "apache software foundation", 80, "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1", "apache software foundation", 80, "this product includes software developed by the apache software foundation"),
    ("apache-1", "apache group", 80, "this product includes software developed by the apache group for use in the apache http server project"),
    ("gpl", "general public license", 70, "the terms of the gnu general public license"),
    ("gpl-2+", "general public license", 88, "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3+", "general public license", 88, "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "general public license", 86, "gnu general public license as published by the free software foundation version 2"),
    ("gpl-2", "general public license", 86, "gnu general public license version 2 only"),
    ("gpl-2", "general public license", 85, "gnu general public license version 2 june 1991"),
    ("gpl-3", "general public license", 85, "gnu general public license version 3 29 june 2007"),
    ("gpl", "general public license", 64, "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "free software", 64, "this program is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl", "merchantability", 61, "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl-classpath", "linking this library statically", 86, "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("lgpl-2", "lesser general public", 88, "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-2", "library general public", 88, "gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-3", "lesser general public", 88, "gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "lesser general public", 66, "you should have received a copy of the gnu lesser general public license along with this"),
    ("agpl-3", "affero general public", 88, "gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3", "affero general public", 85, "gnu affero general public license version 3 19 november 2007"),
    ("agpl", "affero general public", 66, "you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", "free documentation", 84, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "invariant sections", 70, "with no invariant sections no front cover texts and no back cover texts"),
    ("mpl-2", "mozilla public", 88, "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", "mozilla org", 76, "you can obtain one at https? ?mozilla org mpl 2 0"),
    ("mpl-1", "mozilla public", 88, "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("mpl-1", "mozilla org", 74, "www mozilla org mpl"),
    ("npl", "netscape public", 86, "the contents of this file are subject to the netscape public license"),
    ("cddl", "common development and distribution", 88, "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "common development and distribution", 80, "common development and distribution license(?: cddl)?(?: version)?(?: 1 [01])?"),
    ("epl-1", "eclipse public", 88, "made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "eclipse public", 88, "made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl", "eclipse org", 74, "www eclipse org legal epl"),
    ("edl-1", "eclipse distribution", 80, "eclipse distribution license(?: v)? ?1 0"),
    ("eupl", "eupl", 84, "licensed under the eupl version 1 [12]"),
    ("unlicense", "unencumbered software", 86, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy", 82, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "unlicense org", 74, "(?:http )?unlicense org"),
    ("cc0", "has waived", 84, "to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights"),
    ("cc0", "publicdomain zero", 76, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "publicdomain mark", 76, "creativecommons org publicdomain mark 1 0"),
    ("cc-by", "creativecommons org", 76, "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org", 76, "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons org", 76, "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons org", 76, "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org", 76, "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons org", 76, "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-sa", "text is available under", 84, "text is available under the creative commons attribution share ?alike license"),
    ("cc", "some rights reserved", 62, "some rights reserved"),
    ("zlib", "claim that you wrote", 84, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source versions", 76, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "freely", 72, "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("boost-1", "boost software", 88, "distributed under the boost software license version 1 0"),
    ("boost-1", "boost org", 74, "www boost org license 1 0 txt"),
    ("boost-1", "permission is hereby granted", 81, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("wtfpl", "do what the fuck", 84, "you just do what the fuck you want to"),
    ("beerware", "buy me a beer", 86, "you can buy me a beer in return"),
    ("beerware", "beer ware", 84, "the beer ware license"),
    ("json", "for good not evil", 88, "the software shall be used for good not evil"),
    ("artistic-2", "artistic", 84, "you may .{0,60}under the terms of the artistic license 2 0"),
    ("perl", "same terms as perl", 86, "(?:redistribute it and or modify it|distributed) under the same terms as perl itself"),
    ("artistic-1", "freely available", 66, "place your modifications in the public domain or otherwise make them freely available"),
    ("psf-2", "python software foundation", 84, "python software foundation license version 2"),
    ("psf-2", "psf hereby grants", 84, "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("openssl", "openssl toolkit", 84, "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", 84, "this product includes cryptographic software written by eric young"),
    ("php-3", "php software", 84, "this product includes php software freely available from"),
    ("postgresql", "without a written agreement", 84, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("unicode", "unicode data files", 84, "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("ofl-1", "sil open font", 88, "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1", "font software", 70, "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself"),
    ("w3c", "copying this work", 84, "by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("ncsa", "university of illinois", 82, "university of illinois ncsa open source license"),
    ("ms-pl", "accompanying software", 82, "this license governs use of the accompanying software if you use the software you accept this license"),
    ("sleepycat", "complete source code", 84, "redistributions in any form must be accompanied by information on how to obtain complete source code for"),
    ("odbl", "opendatacommons org", 76, "opendatacommons org licenses odbl"),
    ("odc-by", "opendatacommons org", 76, "opendatacommons org licenses by"),
    ("pddl", "opendatacommons org", 76, "opendatacommons org licenses pddl"),
    ("ogl-uk", "open government", 82, "open government licen[sc]e(?: v(?:ersion)? ?[123](?: 0)?)?"),
    ("proprietary", "confidential", 72, "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "strictly prohibited", 72, "unauthori[sz]ed (?:copying|use|distribution|reproduction)(?: (?:copying|use|distribution|reproduction|or|and|of))* .{0,60}is strictly prohibited"),
    ("proprietary", "written permission", 66, "may not be (?:reproduced|copied|distributed|redistributed)(?: .{0,60})? without (?:the )?(?:prior |express )?(?:prior )?written permission"),
    ("non-commercial", "commercial", 66, "(?:for )?non ?commercial (?:use|purposes) only"),
    ("non-commercial", "commercial", 66, "not (?:be used )?for commercial (?:use|purposes)"),
    ("research-only", "research", 66, "(?:for )?(?:academic |scientific )?research (?:use|purposes) only"),
    ("no-ai", "may not be used", 66, "may not be used (?:to train|for training|for the training of) (?:artificial intelligence|ai|machine learning|language models)"),
    ("rail", "use restrictions", 76, "use restrictions as referenced in paragraph 5 must be included"),
    ("llama", "llama", 84, "built with (?:meta )?llama"),
    ("copyleft-next", "copyleft next", 80, "copyleft next(?: 0 3 [01])?"),
    ("elastic-2", "elastic license", 84, "elastic license(?: version)? 2(?: 0)?"),
    ("sspl-1", "server side public", 84, "server side public license(?: version| v)?(?: 1)?"),
    ("busl-1", "business source", 84, "business source license(?: version)?(?: 1 1)?"),
    ("commons-clause", "commons clause", 84, "commons clause license condition v1 0"),
]
#: A document without any of these can't match a rule.
GATE = ("licen", " rights reserved", "public domain", "permission ", "redistribution", " under ", *sorted({k for _, k, _, text in OTHERS if not any(x in text for x in ("license", " rights reserved", "public domain", "permission ", "redistribution", " under "))}))
RULE = "array<struct<keywords:array<string>,rules:array<struct<label:string,priority:int,pattern:string>>>>"


def rules() -> list[dict]:
    made = []
    for label, keyword, name in NAMES:
        for priority, before, after in PHRASINGS:
            made.append({"label": "" if priority == 95 else label, "keywords": keyword.split("|"), "priority": priority, "pattern": f"(?<= ){before}{name}{after}(?= )"})
    return made + [{"label": label, "keywords": k.split("|"), "priority": p, "pattern": f"(?<= ){text}(?= )"} for label, k, p, text in OTHERS]


def blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def detections(norm: Column) -> Column:
    """All intervals of all rules of which a keyword occurs: array of (start, end, priority, label)."""

    def of(rule: Column) -> Column:
        found = F.struct(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)).alias("m"), F.split(norm, rule["pattern"], -1).alias("p"))

        def place(s: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

            def step(acc: Column, i: Column) -> Column:
                begin = acc["at"] + F.length(s["p"][i])
                end = begin + F.length(s["m"][i])
                return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

            each = F.when(F.size(s["m"]) > 0, F.sequence(F.lit(0), F.size(s["m"]) - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(each, start, step, lambda acc: acc["out"])

        spans = F.flatten(F.transform(F.array(found), place))
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), (-rule["priority"]).alias("rank"), rule["label"].alias("label")))

    groups: dict[tuple, list] = {}  # rules with the same keywords are looked up together
    for rule in rules():
        groups.setdefault(tuple(rule["keywords"]), []).append(rule)
    table = F.from_json(F.lit(json.dumps([{"keywords": k, "rules": r} for k, r in groups.items()])), RULE)
    able = F.flatten(F.transform(F.filter(table, lambda g: F.exists(g["keywords"], lambda k: F.contains(norm, k))), lambda g: g["rules"]))
    return F.array_sort(F.flatten(F.transform(able, of)))


def resolved(hits: Column) -> Column:
    """Detections that lie in none before them."""
    start = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<struct<priority:int,start:int,end:int,label:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        one = F.array(F.struct((-x["rank"]).alias("priority"), x["start"].alias("start"), (-x["back"]).alias("end"), x["label"].alias("label")))
        return F.when(-x["back"] <= acc["reach"], acc).otherwise(F.struct((-x["back"]).alias("reach"), F.concat(acc["out"], one).alias("out")))

    return F.aggregate(hits, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places of the phrases, found: array of (priority, start, end, label) in the normalised text."""
    # Lower case of A-Z alone: the Kelvin sign and the dotted capital I are the only other letters whose
    # lower case holds an ASCII letter; another letter takes their place.
    other = F.replace(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\u212a"), F.lit("\u0100")), F.lit("\u0130"), F.lit("\u0100"))
    words = docs.select(F.col(id_col).alias("doc_id"), F.trim(F.regexp_replace(F.lower(other), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")).alias("words"))
    norm = words.select("doc_id", F.concat(F.lit(" "), "words", F.lit(" ")).alias("norm"), F.when(F.col("words") == "", 0).otherwise(blanks(F.col("words")) + 1).cast("long").alias("n_words"))
    text, places = F.col("norm"), []
    for phrase, label in PHRASES.items():
        key, n = F.lit(f" {phrase} "), len(phrase) + 2
        there = F.contains(text, key)
        back = F.reverse(text)
        places.append(
            F.when(
                there,
                F.struct(
                    F.lit(label).alias("label"),
                    F.regexp_count(text, F.lit(f"(?<= ){phrase}(?= )")).cast("long").alias("n"),
                    (blanks(F.substring(text, F.lit(1), F.locate(f" {phrase} ", text))) - 1).cast("long").alias("first"),
                    (F.col("n_words") + 1 - blanks(F.substring(back, F.lit(1), F.locate(f" {phrase} "[::-1], back) + n - 1))).cast("long").alias("last"),
                ),
            )
        )
    gate = F.lit(False)
    for word in GATE:
        gate = gate | F.contains(text, F.lit(word))
    none = F.array().cast("array<struct<start:int,back:int,rank:int,label:string>>")
    hits = norm.select("doc_id", "n_words", F.array_compact(F.array(*places)).alias("places"), F.when(gate, detections(text)).otherwise(none).alias("hits"))
    return hits.select("doc_id", "n_words", "places", resolved(F.col("hits")).alias("found"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, places = F.col("found"), F.col("places")
    base = F.transform(places, lambda x: x["label"])
    own = F.filter(F.transform(found, lambda x: x["label"]), lambda x: x != "")
    best = F.array_max(F.transform(F.filter(found, lambda x: x["label"] != ""), lambda x: x["priority"])) / 100
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
        F.array_min(F.transform(places, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(places, lambda x: x["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.coalesce(best, F.when(F.size(places) > 0, F.lit(0.6)), F.lit(0.0)).alias("score"),
    )

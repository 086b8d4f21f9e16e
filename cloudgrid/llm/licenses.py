"""License scans by ordered signature rules, in column functions alone.

A text is reduced to its words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``), each between single spaces.  A rule is a keyword, a
priority, a label and a regular expression over those words.  A text is asked which keywords it holds, and only the rules of
those are tried; the rules found are located by marking their matches and reading the marks' places off the words, so the work for a
rule grows with the text's length, however many matches there are.

A detection is dropped if another one covers all its words and ranks no lower: a better priority, or the same one over more words, or
the same one over the same words by an earlier rule.  Detections are sorted by place for that, so no pairs are made: the farthest end
so far of each priority decides.  The phrases of ``BASE`` are counted before, and their labels always stay.

Defined cases: null or empty text has no words and score 0; a document is a row, also if ids are repeated or null; other columns are
ignored, so none can clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: phrases that are counted in every text, and their labels
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: confidence of a detection by its priority: grants and full texts, titles with a version, identifiers and addresses, bare names, hints
SCORES = (1.0, 0.9, 0.8, 0.6, 0.3)


class Rule(NamedTuple):
    keyword: str
    priority: int
    label: str
    pattern: str

    @property
    def body(self) -> str:
        """The pattern over words that each follow a space; the space after the last is looked at, not taken."""
        return " " + self.pattern


# keyword | priority | label | pattern: words are parted by single spaces, optional words bring their own
_WRITTEN = """
permission | 1 | mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
permission | 1 | isc | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
permission | 1 | 0bsd | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software
permission | 1 | hpnd | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
permission | 1 | bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
permission | 1 | postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
permission | 1 | ofl-1.1 | permission is hereby granted free of charge to any person obtaining a copy of the font software
permission | 1 | gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
permission | 1 | zlib | permission is granted to anyone to use this software for any purpose including commercial applications
released | 1 | mit | released under the(?: terms of the)? mit license
licensed | 1 | mit | (?:is |are )?licensed under the(?: terms of the)? mit license
distributed | 1 | mit | distributed under the(?: terms of the)? mit license
available | 1 | mit | available under the(?: terms of the)? mit license
mit | 2 | mit | the mit license mit
expat | 4 | mit | expat license
x11 | 4 | x11 | (?:mit )?x11 license
mit | 4 | mit | mit licen[sc]e
mit | 4 | mit | mit licen[sc]ed
mit | 3 | mit | licen[sc]e mit
mit | 4 | mit-0 | mit no attribution
modern | 4 | mit-modern | mit license modern variant
licensed | 1 | apache-2.0 | (?:is |are )?licensed under the apache license version 2 0(?: the license)?
licensed | 1 | apache-2.0 | (?:is |are )?licensed under the(?: terms of the)? apache(?: software)? license v?2(?: 0)?
licensed | 1 | apache-2.0 | licensed to the apache software foundation asf under one or more contributor license agreements
released | 1 | apache-2.0 | released under the(?: terms of the)? apache(?: software)? license(?: version)? v?2(?: 0)?
distributed | 1 | apache-2.0 | distributed under the(?: terms of the)? apache(?: software)? license(?: version)? v?2(?: 0)?
apache | 2 | apache-2.0 | apache(?: software)? license(?: version)? v?2(?: 0)?
apache | 2 | apache-1.1 | apache(?: software)? license(?: version)? v?1 1
apache | 2 | apache-1.0 | apache(?: software)? license(?: version)? v?1 0
apache | 3 | apache-2.0 | apache org licenses license 2 0
apache | 3 | apache-2.0 | apache 2 0
apache | 4 | apache | apache licen[sc]e
apache | 4 | apache | apache software license
apache | 4 | apache | apache licensed
asl | 3 | apache-2.0 | asl 2 0
licensed | 1 | gpl-3.0 | licensed under the(?: terms of the)?(?: gnu)? general public license(?: gpl)?(?: version| v)? ?v?3(?: 0)?
licensed | 1 | gpl-2.0 | licensed under the(?: terms of the)?(?: gnu)? general public license(?: gpl)?(?: version| v)? ?v?2(?: 0)?
licensed | 1 | lgpl-2.1 | licensed under the(?: terms of the)?(?: gnu)? (?:lesser|library) general public license(?: lgpl)?(?: version| v)? ?v?2 1
licensed | 1 | lgpl-3.0 | licensed under the(?: terms of the)?(?: gnu)? lesser general public license(?: lgpl)?(?: version| v)? ?v?3(?: 0)?
licensed | 1 | agpl-3.0 | licensed under the(?: terms of the)?(?: gnu)? affero general public license(?: agpl)?(?: version| v)? ?v?3(?: 0)?
redistribute | 1 | gpl-2.0-or-later | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
redistribute | 1 | gpl-3.0-or-later | redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
redistribute | 1 | gpl-2.0-only | redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation
redistribute | 1 | gpl-3.0-only | redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation
redistribute | 1 | lgpl-2.1-or-later | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1
redistribute | 1 | lgpl-3.0-or-later | redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3
redistribute | 1 | lgpl-2.0-or-later | redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2
redistribute | 1 | agpl-3.0-or-later | redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3
public | 2 | gpl-1.0 | (?:gnu )?general public license(?: gpl)?(?: version)? v?1(?: 0)?
public | 2 | gpl-2.0 | (?:gnu )?general public license(?: gpl)?(?: version)? v?2(?: 0)?
public | 2 | gpl-3.0 | (?:gnu )?general public license(?: gpl)?(?: version)? v?3(?: 0)?
public | 2 | gpl-2.0-or-later | (?:gnu )?general public license(?: gpl)?(?: version)? v?2(?: 0)? or(?: at your option)? any later
public | 2 | gpl-3.0-or-later | (?:gnu )?general public license(?: gpl)?(?: version)? v?3(?: 0)? or(?: at your option)? any later
lesser | 2 | lgpl-2.1 | (?:gnu )?lesser general public license(?: lgpl)?(?: version)? v?2 1
lesser | 2 | lgpl-3.0 | (?:gnu )?lesser general public license(?: lgpl)?(?: version)? v?3(?: 0)?
library | 2 | lgpl-2.0 | (?:gnu )?library general public license(?: lgpl)?(?: version)? v?2(?: 0)?
affero | 2 | agpl-3.0 | (?:gnu )?affero general public license(?: agpl)?(?: version)? v?3(?: 0)?
affero | 2 | agpl-1.0 | (?:gnu )?affero general public license(?: agpl)?(?: version)? v?1(?: 0)?
public | 4 | gpl | (?:gnu )?general public licen[sc]e
lesser | 4 | lgpl | (?:gnu )?lesser general public licen[sc]e
library | 4 | lgpl | (?:gnu )?library general public licen[sc]e
affero | 4 | agpl | (?:gnu )?affero general public licen[sc]e
gpl | 3 | gpl-1.0 | (?:gnu )?gpl(?: version)? v?1(?: 0)?
gpl | 3 | gpl-2.0 | (?:gnu )?gpl(?: version)? v?2(?: 0)?
gpl | 3 | gpl-3.0 | (?:gnu )?gpl(?: version)? v?3(?: 0)?
gpl | 3 | gpl-2.0-or-later | gpl 2 0 or later
gpl | 3 | gpl-3.0-or-later | gpl 3 0 or later
gpl | 3 | gpl-2.0-only | gpl 2 0 only
gpl | 3 | gpl-3.0-only | gpl 3 0 only
gplv2 | 3 | gpl-2.0 | gplv2
gplv3 | 3 | gpl-3.0 | gplv3
lgplv2 | 3 | lgpl-2.1 | lgplv2(?: 1)?
lgplv3 | 3 | lgpl-3.0 | lgplv3
agplv3 | 3 | agpl-3.0 | agplv3
lgpl | 3 | lgpl-2.1 | lgpl(?: version)? v?2 1
lgpl | 3 | lgpl-3.0 | lgpl(?: version)? v?3(?: 0)?
agpl | 3 | agpl-3.0 | agpl(?: version)? v?3(?: 0)?
gpl | 4 | gpl | gpl licen[sc]ed?
gpl | 5 | gpl | (?:the|gnu|under) gpl
lgpl | 5 | lgpl | (?:the|gnu|under) lgpl
agpl | 5 | agpl | (?:the|gnu|under) agpl
gnu | 3 | gpl-2.0 | gnu org licenses(?: old licenses)? gpl 2 0
gnu | 3 | gpl-3.0 | gnu org licenses gpl(?: 3 0)? html
gnu | 3 | lgpl-2.1 | gnu org licenses(?: old licenses)? lgpl 2 1
gnu | 3 | agpl-3.0 | gnu org licenses agpl(?: 3 0)?
documentation | 2 | gfdl-1.1 | (?:gnu )?free documentation license version 1 1
documentation | 2 | gfdl-1.2 | (?:gnu )?free documentation license version 1 2
documentation | 2 | gfdl-1.3 | (?:gnu )?free documentation license version 1 3
documentation | 4 | gfdl | (?:gnu )?free documentation licen[sc]e
redistribution | 1 | bsd | redistribution and use in source and binary forms with or without modification are permitted
advertising | 1 | bsd-4-clause | all advertising materials mentioning features or use of this software must display
contributors | 1 | bsd-3-clause | neither the name of(?: \\S+){1,8} nor the names of its contributors may be used to endorse or promote
bsd | 2 | bsd-2-clause | (?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?
freebsd | 2 | bsd-2-clause | freebsd license
bsd | 2 | bsd-3-clause | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
bsd | 2 | bsd-4-clause | (?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?
bsd | 2 | 0bsd | (?:bsd zero clause|zero clause bsd)(?: license)?
bsd | 4 | bsd | bsd(?: style)? licen[sc]ed?
licensed | 1 | bsd | licensed under the(?: terms of the)? bsd license
isc | 4 | isc | isc licen[sc]e
source | 1 | mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2 0
contents | 1 | mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1
mozilla | 2 | mpl-1.0 | mozilla public license(?: version| v)? ?1 0
mozilla | 2 | mpl-1.1 | mozilla public license(?: version| v)? ?1 1
mozilla | 2 | mpl-2.0 | mozilla public license(?: version| v)? ?2 0
mozilla | 3 | mpl-2.0 | mozilla org mpl 2 0
mozilla | 4 | mpl | mozilla public licen[sc]e
mpl | 3 | mpl-1.1 | mpl(?: version)? v?1 1
mpl | 3 | mpl-2.0 | mpl(?: version)? v?2(?: 0)?
program | 1 | epl-1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
program | 1 | epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
eclipse | 2 | epl-1.0 | eclipse public license(?: version)? v? ?1 0
eclipse | 2 | epl-2.0 | eclipse public license(?: version)? v? ?2 0
eclipse | 4 | epl | eclipse public licen[sc]e
eclipse | 4 | edl-1.0 | eclipse distribution license
epl | 3 | epl-1.0 | epl v?1 0
epl | 3 | epl-2.0 | epl v?2 0
common | 2 | cpl-1.0 | common public license version 1 0
common | 2 | cddl-1.0 | common development and distribution license(?: cddl)?(?: version)? v?1 0
common | 2 | cddl-1.1 | common development and distribution license(?: cddl)?(?: version)? v?1 1
common | 4 | cpl | common public licen[sc]e
common | 4 | cddl | common development and distribution licen[sc]e
cddl | 3 | cddl-1.0 | cddl(?: version)? v?1 0
free | 1 | unlicense | this is free and unencumbered software released into the public domain
unlicense | 4 | unlicense | the unlicense
unlicense | 3 | unlicense | unlicense org
wtfpl | 4 | wtfpl | wtfpl
want | 2 | wtfpl | do what the f\\S{0,4} you want to public license
domain | 1 | public-domain | (?:is |are )?(?:released|placed|dedicated) (?:into|in|to) the public domain
domain | 5 | public-domain | public domain
dedication | 1 | cc0-1.0 | cc0 1 0 universal(?: cc0 1 0)? public domain dedication
cc0 | 2 | cc0-1.0 | cc0 1 0 universal
cc0 | 3 | cc0-1.0 | cc0(?: 1 0)?
software | 1 | zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 4 | zlib | zlib(?: libpng)? licen[sc]e
libpng | 4 | libpng | libpng licen[sc]e
boost | 1 | bsl-1.0 | distributed under the boost software license version 1 0
boost | 2 | bsl-1.0 | boost software license version 1 0
boost | 4 | bsl-1.0 | boost software licen[sc]e
boost | 3 | bsl-1.0 | boost org license 1 0 txt
artistic | 2 | artistic-1.0 | artistic license(?: version)? 1 0
artistic | 2 | artistic-2.0 | artistic license(?: version)? 2 0
artistic | 4 | artistic | artistic licen[sc]e
perl | 1 | artistic-1.0-perl | under the same terms as perl itself
python | 2 | psf-2.0 | python software foundation license version 2
python | 4 | psf | python software foundation licen[sc]e
psf | 3 | psf | psf licen[sc]e
open | 2 | ofl-1.1 | open font license(?: version)? 1 1
open | 4 | ofl | open font licen[sc]e
open | 2 | osl-3.0 | open software license(?: version| v)? ?3 0
open | 4 | osl | open software licen[sc]e
open | 2 | odbl-1.0 | open (?:database|data commons open database) license(?: odbl)?(?: v)? ?1 0
open | 4 | odbl | open database licen[sc]e
open | 2 | ogl-uk-3.0 | open government licen[sc]e v3 0
open | 4 | ogl | open government licen[sc]e
academic | 2 | afl-3.0 | academic free license(?: version| v)? ?3 0
academic | 4 | afl | academic free licen[sc]e
european | 2 | eupl-1.1 | european union public licen[sc]e(?: version| v)? ?1 1
european | 2 | eupl-1.2 | european union public licen[sc]e(?: version| v)? ?1 2
european | 4 | eupl | european union public licen[sc]e
cecill | 3 | cecill-2.1 | cecill(?: version| v)? 2 1
cecill | 4 | cecill | cecill(?: [bc])?(?: free software)? licen[sc]e
microsoft | 2 | ms-pl | microsoft public license(?: ms pl)?
microsoft | 2 | ms-rl | microsoft reciprocal license(?: ms rl)?
illinois | 2 | ncsa | university of illinois(?: ncsa)? open source license
postgresql | 4 | postgresql | postgresql licen[sc]e
ruby | 4 | ruby | ruby licen[sc]e
ruby | 1 | ruby | under the same terms as ruby
php | 2 | php-3.01 | php license(?: version| v)? ?3 01
php | 4 | php | php licen[sc]e
openssl | 4 | openssl | openssl licen[sc]e
vim | 4 | vim | vim licen[sc]e
beer | 1 | beerware | if we meet some day and you think this stuff is worth it you can buy me a beer
beerware | 4 | beerware | beerware(?: licen[sc]e)?
json | 4 | json | json licen[sc]e
evil | 1 | json | the software shall be used for good not evil
latex | 2 | lppl-1.3c | latex project public license(?: version)? 1 3c?
latex | 4 | lppl | latex project public licen[sc]e
lppl | 3 | lppl | lppl(?: 1 3c?)?
sleepycat | 4 | sleepycat | sleepycat licen[sc]e
ibm | 4 | ipl-1.0 | ibm public licen[sc]e
apple | 2 | apsl-2.0 | apple public source license(?: version)? 2 0
apple | 4 | apsl | apple public source licen[sc]e
q | 4 | qpl | q public licen[sc]e
server | 4 | sspl-1.0 | server side public licen[sc]e
business | 2 | busl-1.1 | business source license(?: version)? 1 1
business | 4 | busl | business source licen[sc]e
elastic | 2 | elastic-2.0 | elastic license(?: version| v)? ?2(?: 0)?
elastic | 4 | elastic | elastic licen[sc]e
commons | 4 | commons-clause | commons clause license
proprietary | 4 | proprietary | proprietary licen[sc]e
confidential | 1 | proprietary | proprietary and confidential
rights | 5 | copyright | all rights reserved
copyright | 5 | copyright | copyright(?: c)? [0-9]{4}
license | 5 | notice | see(?: the)? license file for
license | 5 | notice | see(?: the)? (?:file )?licen[sc]e(?: file)? for(?: more| further)?(?: details| information)
agreement | 4 | eula | end user licen[sc]e agreement(?: eula)?
commercial | 5 | commercial | commercial licen[sc]e
dual | 5 | dual | dual licen[sc]ed
"""

#: identifiers as SPDX writes them, whose tags and addresses make two rules each
_IDENTIFIERS = """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0
BUSL-1.1 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 CDDL-1.0 CPL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only
GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0
PostgreSQL Unlicense WTFPL Zlib""".split()


def _families() -> list[Rule]:
    """Rules that a few words span: tags and addresses of identifiers, and the six Creative Commons licenses by version."""
    out = []
    for i in _IDENTIFIERS:
        words = i.lower().replace("-", " ").replace(".", " ")
        out.append(Rule("spdx", 3, i.lower(), f"spdx license identifier {words}"))
        out.append(Rule("licenses", 3, i.lower(), f"(?:opensource|spdx|choosealicense) (?:org|com) licenses {words}"))
    long = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
    for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        name = " ".join(long[k] for k in kind.split())
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{kind.replace(' ', '-')}-{version.replace(' ', '.')}"
            out.append(Rule("licensed", 1, label, f"licensed under(?: an?| the)? cc {kind} {version}"))
            out.append(Rule("cc", 3, label, f"cc {kind} {version}"))
            out.append(Rule("creative", 2, label, f"creative commons {name}(?: v)? ?{version}"))
            out.append(Rule("creativecommons", 3, label, f"creativecommons org licenses {kind} {version}"))
        out.append(Rule("cc", 4, f"cc-{kind.replace(' ', '-')}", f"cc {kind}"))
        out.append(Rule("creative", 4, f"cc-{kind.replace(' ', '-')}", f"creative commons {name}"))
    return out


#: in order; of two that agree in all else the earlier wins
RULES: tuple[Rule, ...] = tuple(Rule(k, int(p), label, x) for k, p, label, x in ([c.strip() for c in line.split("|", 3)] for line in _WRITTEN.strip().splitlines())) + tuple(_families())

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: the only sign beyond ASCII whose small letter is an ASCII one, and one of no word in a rule to stand for it
_KELVIN, _OTHER = "\u212a", "\u03a9"
_DETECTION = "array<struct<rule:int,first:bigint,last:bigint>>"


def normal(text: Column) -> Column:
    """The words, lower-cased, each between single spaces: `` w0 w1 .. ``.

    lower() is right for A-Z and much faster than translate(); what it does to letters beyond ASCII can't make up a word of a rule,
    but for the Kelvin sign, which goes first.
    """
    spaced = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), _BETWEEN, " ")
    return F.lower(F.replace(spaced, F.lit(_KELVIN), F.lit(_OTHER)))


def _located(text: Column, bodies: Column, rule: Column) -> Column:
    """The detections of one rule: a mark before the first and after the last word of each match, read off the words between spaces."""
    marked = F.regexp_replace(text, F.concat(F.lit("("), F.get(bodies, rule), F.lit(")(?= )")), F.lit("\u0001$1\u0002"))
    words = F.split(marked, " ", -1)  # word k is element k + 1

    def places(mark: str) -> Column:
        held = F.transform(words, lambda w, k: F.when(w.contains(mark), k))
        return F.filter(held, lambda k: k.isNotNull())

    return F.zip_with(places("\u0001"), places("\u0002"), lambda a, b: F.struct(rule.alias("rule"), a.cast("long").alias("first"), (b - 1).cast("long").alias("last")))


def detections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, _n_words, _found) of every row: all matches of all rules, as (rule, first, last); rules beyond the list are the phrases of BASE.  Map only."""
    every = [*rules, *(Rule(p.split(" ")[0], 0, label, p) for p, label in BASE)]
    keywords = sorted({r.keyword for r in every})
    text, held = F.col("_text"), F.col("_held")
    rows = docs.select(F.col(id_col), normal(F.col(text_col)).alias("_text"))
    # a longer word that ends with a keyword lets its rules be tried in vain; without a space before it, texts are searched by a rarer byte
    asked = F.array_compact(F.array(*[F.when(text.contains(k + " "), F.lit(k)) for k in keywords]))
    rows = rows.select(id_col, "_text", asked.alias("_held"))
    tried = [F.when(F.array_contains(held, r.keyword) & text.rlike(r.body + "(?= )"), F.lit(i)) for i, r in enumerate(every)]
    none = F.array().cast("array<int>")
    rows = rows.select(id_col, "_text", F.when(F.size(held) > 0, F.array_compact(F.array(*tried))).otherwise(none).alias("_rules"))
    bodies = F.array(*[F.lit(r.body) for r in every])
    found = F.flatten(F.transform("_rules", lambda r: _located(text, bodies, r)))
    n = F.greatest(F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) - 1, F.lit(0))
    return rows.select(id_col, n.cast("long").alias("_n_words"), F.when(F.size("_rules") > 0, found).otherwise(F.array().cast(_DETECTION)).cast(_DETECTION).alias("_found"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, _n_words, _base, _detections, _score) of every row.

    ``_base``: (label, first, last) of all places of the phrases; ``_detections``: (label, priority, first, last) of those that no other
    one suppresses, in order of place; ``_score``: the best one's confidence, 0 without any.  Texts are read once; what was found
    becomes a table, and only rows with a detection are sorted, by document.
    """
    rows = cut(detections(docs, id_col, text_col, rules).withColumn("_row", F.monotonically_increasing_id()))
    named = F.array(*[F.lit(label) for _, label in BASE])
    is_base = lambda d: d["rule"] >= len(rules)
    base = F.transform(F.filter("_found", is_base), lambda d: F.struct(F.get(named, d["rule"] - len(rules)).alias("label"), d["first"].alias("first"), d["last"].alias("last")))
    rows = rows.select("_row", id_col, "_n_words", F.array_sort(base).alias("_base"), F.filter("_found", lambda d: ~is_base(d)).alias("_found"))
    kind = "array<struct<label:string,priority:int,first:bigint,last:bigint>>"
    rest = rows.where(F.size("_found") == 0).select(id_col, "_n_words", "_base", F.array().cast(kind).alias("_detections"), F.lit(0.0).alias("_score"))
    labels, priorities = F.array(*[F.lit(r.label) for r in rules]), F.array(*[F.lit(r.priority) for r in rules])
    each = rows.where(F.size("_found") > 0).select("_row", F.explode("_found").alias("d")).select("_row", "d.*").withColumns({"label": F.get(labels, F.col("rule")), "priority": F.get(priorities, F.col("rule"))})
    w = Window.partitionBy("_row").orderBy("first", F.desc("last"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = range(1, len(SCORES) + 1)
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(F.col("priority") <= p, F.col("last"))).over(w)) for p in levels])
    kept = each.withColumn("_reach", reach).where("_reach is null or _reach < last")
    score = F.max(F.get(F.array(*[F.lit(s) for s in SCORES]), F.col("priority") - 1))
    one = kept.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("first", "last", "priority", "label"))).alias("_d"), score.alias("_score"))
    ordered = F.transform("_d", lambda d: F.struct(d["label"].alias("label"), d["priority"].alias("priority"), d["first"].alias("first"), d["last"].alias("last")))
    some = rows.where(F.size("_found") > 0).drop("_found").join(one, "_row").select(id_col, "_n_words", "_base", ordered.cast(kind).alias("_detections"), "_score")
    return rest.unionByName(some)

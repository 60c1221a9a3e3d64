"""License scan from DataFrame functions only: ordered signature rules, gated by keywords, overlaps resolved.

Text is taken with A-Z lower-cased; a word is a run of 0-9, a-z and everything beyond ASCII. Each signature rule has a
label, a priority, a keyword and a regular expression over words. A document is looked at closely only if it holds one
of a few stems that every rule needs; then a rule runs only if the document holds its keyword. What the rules find are
spans of the text. A span that lies within one of another label with a higher priority (or of the same priority, but
longer) is suppressed; spans that merely overlap stay. Base phrases are places where given words stand consecutively;
they are counted all, and their labels are never suppressed.

Defined results: a null or empty text has no words, no labels and the score 0; repeated rows stay repeated; a null key
passes through; other columns are not read; an empty table gives no rows. The work is per row, without Python; one shuffle
deals the rows to all cores.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import dealt

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, once lower-cased; what words are made of; and words in text that isn't lower-cased yet. Words by what
#: they have, not by what they lack: java.util.regex takes some ten times as long for negated classes of ranges.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BEYOND = "\u0080-\U0010ffff"
_IN = f"[0-9a-z{_BEYOND}]"
_ANY_WORD = f"[0-9A-Za-z{_BEYOND}]+"


class Signature(NamedTuple):
    label: str
    priority: int
    keyword: str
    regex: str


def over_words(pattern: str) -> str:
    """A pattern in which a space stands for whatever parts two words, one before ``?`` for that or nothing, tied to word limits; ``[^ ]`` stays."""
    parts = [x.replace(" ?", f"(?:{_GAP})?").replace(" ", _GAP) for x in pattern.split("[^ ]")]
    return f"(?<!{_IN})(?:{'[^ ]'.join(parts)})(?!{_IN})"


#: Phrases and labels of the base, in the order given.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: One of these is in every text that a rule can match; single words or parts of words, as anything may part two words.
STEMS = ("licen", "gpl", "cc", "copyright", "warrant", "public", "creative", "apache", "bsd", "spdx", "domain", "copyleft", "reserved", "trademark", "patent", "proprietary", "redistribut", "permi", "terms", "fair", "cddl", "cecill", "eupl", "wtfpl", "commons", "jpeg", "neither", "good", "applicable", "mulan", "agree", "released")

# fmt: off
#: Hand-written signatures: label, priority, keyword, pattern. Higher priorities are more specific.
_TEXT = r"""
gpl-1.0 90 gpl | gpl(?: v| version| )?1(?: 0)?
gpl-2.0 90 gpl | gpl(?: v| version| )?2(?: 0)?
gpl-2.0 90 gpl | gplv2
gpl-2.0-or-later 95 gpl | gpl(?: v| version| )?2(?: 0)? or (?:any )?later
gpl-2.0-or-later 95 gpl | gplv2 or (?:any )?later
gpl-3.0 90 gpl | gpl(?: v| version| )?3(?: 0)?
gpl-3.0 90 gpl | gplv3
gpl-3.0-or-later 95 gpl | gpl(?: v| version| )?3(?: 0)? or (?:any )?later
gpl-3.0-or-later 95 gpl | gplv3 or (?:any )?later
gpl-1.0 90 general public | gnu general public licen[cs]e (?:v|version )?1(?: 0)?
gpl-2.0 90 general public | gnu general public licen[cs]e (?:v|version )?2(?: 0)?
gpl-2.0-or-later 95 general public | gnu general public licen[cs]e (?:v|version )?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0 90 general public | gnu general public licen[cs]e (?:v|version )?3(?: 0)?
gpl-3.0-or-later 95 general public | gnu general public licen[cs]e (?:v|version )?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl 60 general public | gnu general public licen[cs]e
gpl 55 gpl | (?:gnu )?gpl licen[cs]e
gpl 55 gpl | licen[cs]ed under (?:the )?(?:gnu )?gpl
gpl-notice 70 free software foundation | terms of the gnu general public licen[cs]e as published by the free software foundation
gpl-notice 70 redistribute it | you can redistribute it and or modify it under the terms of
gpl-header 70 everyone is permitted | everyone is permitted to copy and distribute verbatim copies
lgpl-2.0 92 library general public | gnu library general public licen[cs]e(?: (?:v|version )?2(?: 0)?)?
lgpl-2.1 92 lesser general public | gnu lesser general public licen[cs]e (?:v|version )?2 1
lgpl-3.0 92 lesser general public | gnu lesser general public licen[cs]e (?:v|version )?3(?: 0)?
lgpl 70 lesser general public | (?:gnu )?lesser general public licen[cs]e
lgpl-2.1 92 lgpl | lgpl(?: v| version| )?2 1
lgpl-3.0 92 lgpl | lgpl(?: v| version| )?3(?: 0)?
lgpl-3.0 92 lgpl | lgplv3
lgpl 65 lgpl | lgpl
agpl-1.0 92 affero | affero general public licen[cs]e (?:v|version )?1(?: 0)?
agpl-3.0 92 affero | (?:gnu )?affero general public licen[cs]e (?:v|version )?3(?: 0)?
agpl-3.0 92 agpl | agpl(?: v| version| )?3(?: 0)?
agpl-3.0 92 agpl | agplv3
agpl 70 affero | (?:gnu )?affero general public licen[cs]e
agpl 65 agpl | agpl
gfdl-1.1 92 free documentation | gnu free documentation licen[cs]e (?:v|version )?1 1
gfdl-1.2 92 free documentation | gnu free documentation licen[cs]e (?:v|version )?1 2
gfdl-1.3 92 free documentation | gnu free documentation licen[cs]e (?:v|version )?1 3
gfdl 70 free documentation | gnu free documentation licen[cs]e
apache-1.0 90 apache | apache (?:software )?licen[cs]e (?:v|version )?1 0
apache-1.1 90 apache | apache (?:software )?licen[cs]e (?:v|version )?1 1
apache-2.0 90 apache | apache (?:software )?licen[cs]e (?:v|version )?2(?: 0)?
apache-2.0 90 apache | apache 2(?: 0)?(?: licen[cs]e)?
apache 60 apache | apache (?:software )?licen[cs]e
apache-url 85 apache | www apache org licenses license 2 0
apache-notice 70 unless required by | unless required by applicable law or agreed to in writing software
mit 60 mit licen | mit licen[cs]e
mit 60 mit | licen[cs]ed under (?:the )?mit
mit 60 mit | released under (?:the )?mit
mit-0 92 mit | mit (?:no attribution|0) licen[cs]e
expat 60 expat | expat licen[cs]e
x11 60 x11 | x11 licen[cs]e
mit-text 80 permission is hereby | permission is hereby granted free of charge to any person obtaining a copy
mit-text 80 without warranty of | the software is provided as is without warranty of any kind
isc 60 isc | isc licen[cs]e
isc-text 80 permission to use | permission to use copy modify and or distribute this software for any purpose
bsd-1-clause 90 bsd | bsd 1 clause(?: licen[cs]e)?
bsd-2-clause 90 bsd | bsd 2 clause(?: licen[cs]e)?
bsd-2-clause 90 bsd | simplified bsd(?: licen[cs]e)?
bsd-2-clause 90 bsd | freebsd licen[cs]e
bsd-3-clause 90 bsd | bsd 3 clause(?: licen[cs]e)?
bsd-3-clause 90 bsd | (?:new|revised|modified) bsd(?: licen[cs]e)?
bsd-4-clause 90 bsd | bsd 4 clause(?: licen[cs]e)?
bsd-4-clause 90 bsd | original bsd(?: licen[cs]e)?
bsd-0-clause 90 bsd | (?:zero clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)?
bsd 60 bsd | bsd(?: style)? licen[cs]e
bsd-text 75 redistribution and use | redistribution and use in source and binary forms
bsd-text 75 neither the name | neither the name of .{1,80}? nor the names of its contributors
bsd-text 75 redistributions of source | redistributions of source code must retain the above copyright notice
cc-by-1.0 92 cc | cc by 1 0
cc-by-2.0 92 cc | cc by 2 0
cc-by-2.5 92 cc | cc by 2 5
cc-by-3.0 92 cc | cc by 3 0
cc-by-4.0 92 cc | cc by 4 0
cc-by-sa-2.0 94 cc | cc by sa 2 0
cc-by-sa-2.5 94 cc | cc by sa 2 5
cc-by-sa-3.0 94 cc | cc by sa 3 0
cc-by-sa-4.0 94 cc | cc by sa 4 0
cc-by-nc-2.0 94 cc | cc by nc 2 0
cc-by-nc-3.0 94 cc | cc by nc 3 0
cc-by-nc-4.0 94 cc | cc by nc 4 0
cc-by-nd-3.0 94 cc | cc by nd 3 0
cc-by-nd-4.0 94 cc | cc by nd 4 0
cc-by-nc-sa-3.0 96 cc | cc by nc sa 3 0
cc-by-nc-sa-4.0 96 cc | cc by nc sa 4 0
cc-by-nc-nd-3.0 96 cc | cc by nc nd 3 0
cc-by-nc-nd-4.0 96 cc | cc by nc nd 4 0
cc-by-nc-sa 76 cc | cc by nc sa
cc-by-nc-nd 76 cc | cc by nc nd
cc-by-sa 74 cc | cc by sa
cc-by-nc 74 cc | cc by nc
cc-by-nd 74 cc | cc by nd
cc-by 60 cc | cc by
cc-by-4.0 92 attribution | creative commons attribution 4 0(?: international)?(?: licen[cs]e)?
cc-by-3.0 92 attribution | creative commons attribution 3 0(?: unported)?(?: licen[cs]e)?
cc-by-2.0 92 attribution | creative commons attribution 2 0(?: generic)?(?: licen[cs]e)?
cc-by-sa-4.0 94 sharealike | creative commons attribution sharealike 4 0(?: international)?(?: licen[cs]e)?
cc-by-sa-3.0 94 sharealike | creative commons attribution sharealike 3 0(?: unported)?(?: licen[cs]e)?
cc-by-nc-4.0 94 noncommercial | creative commons attribution noncommercial 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-3.0 94 noncommercial | creative commons attribution noncommercial 3 0(?: unported)?(?: licen[cs]e)?
cc-by-nd-4.0 94 noderiv | creative commons attribution noderiv(?:ative)?s 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-sa-4.0 96 noncommercial | creative commons attribution noncommercial sharealike 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-nd-4.0 96 noncommercial | creative commons attribution noncommercial noderiv(?:ative)?s 4 0(?: international)?(?: licen[cs]e)?
cc-by-nc-sa 76 noncommercial | creative commons attribution noncommercial sharealike
cc-by-nc-nd 76 noncommercial | creative commons attribution noncommercial noderiv(?:ative)?s
cc-by-sa 74 alike | creative commons attribution share ?alike
cc-by-nc 74 commercial | creative commons attribution non ?commercial
cc-by-nd 74 deriv | creative commons attribution no ?deriv(?:ative)?s
cc-by 60 attribution | creative commons attribution(?: licen[cs]e)?
cc-url-by 85 creativecommons | creativecommons org licenses by [1-4] [05]
cc-url-by-sa 87 creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-url-by-nc 87 creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-url-by-nd 87 creativecommons | creativecommons org licenses by nd [1-4] [05]
cc-url-by-nc-sa 89 creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-url-by-nc-nd 89 creativecommons | creativecommons org licenses by nc nd [1-4] [05]
cc-url-zero 89 creativecommons | creativecommons org publicdomain zero 1 0
cc-url-mark 89 creativecommons | creativecommons org publicdomain mark 1 0
cc0-1.0 90 cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 90 creative commons zero | creative commons zero(?: v?1 0)?(?: universal)?
cc-pdm 85 public domain mark | (?:creative commons )?public domain mark(?: 1 0)?
creative-commons 40 creative commons | creative commons(?: licen[cs]e)?
mpl-1.0 90 mozilla | mozilla public licen[cs]e (?:v|version )?1 0
mpl-1.1 90 mozilla | mozilla public licen[cs]e (?:v|version )?1 1
mpl-2.0 90 mozilla | mozilla public licen[cs]e (?:v|version )?2(?: 0)?
mpl 60 mozilla | mozilla public licen[cs]e
mpl-2.0 90 mpl | licen[cs]ed under (?:the )?mpl 2(?: 0)?
epl-1.0 90 eclipse | eclipse public licen[cs]e (?:v|version )?1(?: 0)?
epl-2.0 90 eclipse | eclipse public licen[cs]e (?:v|version )?2(?: 0)?
epl 60 eclipse | eclipse public licen[cs]e
edl-1.0 80 eclipse | eclipse distribution licen[cs]e(?: (?:v|version )?1(?: 0)?)?
cddl-1.0 90 cddl | cddl(?: licen[cs]e)?(?: (?:v|version )?1 0)
cddl-1.1 90 cddl | cddl(?: licen[cs]e)?(?: (?:v|version )?1 1)
cddl 60 common development | common development and distribution licen[cs]e
cpl-1.0 70 common public licen | common public licen[cs]e(?: (?:v|version )?1(?: 0)?)?
ipl-1.0 70 ibm public | ibm public licen[cs]e
artistic-1.0 90 artistic | artistic licen[cs]e (?:v|version )?1 0
artistic-2.0 90 artistic | artistic licen[cs]e (?:v|version )?2(?: 0)?
artistic 60 artistic | artistic licen[cs]e
perl 70 perl | same terms as perl(?: itself)?
zlib 60 zlib | zlib licen[cs]e
libpng 60 libpng | libpng licen[cs]e
boost-1.0 80 boost | boost software licen[cs]e(?: (?:v|version )?1 0)?
wtfpl 80 wtfpl | wtfpl
unlicense 80 unlicense | (?:the )?unlicense
unlicense 80 public domain | this is free and unencumbered software released into the public domain
beerware 80 beer | beer ?ware licen[cs]e
ofl-1.1 80 open font | sil open font licen[cs]e(?: (?:v|version )?1 1)?
ofl 60 open font | open font licen[cs]e
ms-pl 70 microsoft public | microsoft public licen[cs]e
ms-rl 70 microsoft reciprocal | microsoft reciprocal licen[cs]e
ms-eula 60 microsoft | microsoft software licen[cs]e terms
eupl-1.1 90 eupl | eupl (?:v|version )?1 1
eupl-1.2 90 eupl | eupl (?:v|version )?1 2
eupl 60 european union public | european union public licen[cs]e
cecill-2.1 90 cecill | cecill (?:v|version )?2 1
cecill-b 80 cecill | cecill b
cecill-c 80 cecill | cecill c
cecill 60 cecill | cecill(?: licen[cs]e)?
osl-3.0 80 open software licen | open software licen[cs]e(?: (?:v|version )?3 0)?
afl-3.0 80 academic free | academic free licen[cs]e(?: (?:v|version )?3 0)?
ecl-2.0 80 educational community | educational community licen[cs]e(?: (?:v|version )?2 0)?
python-2.0 80 python software foundation | python software foundation licen[cs]e(?: (?:v|version )?2)?
php-3.0 80 php licen | php licen[cs]e(?: (?:v|version )?3 0)?
php-3.01 85 php licen | php licen[cs]e (?:v|version )?3 01
ruby 70 ruby licen | ruby licen[cs]e
openssl 70 openssl | openssl licen[cs]e
postgresql 70 postgresql | postgresql licen[cs]e
ncsa 70 ncsa | (?:university of illinois )?ncsa open source licen[cs]e
w3c 70 w3c | w3c (?:software )?(?:notice and )?licen[cs]e
zope-2.1 70 zope | zope public licen[cs]e(?: (?:v|version )?2 1)?
qpl-1.0 70 q public | q public licen[cs]e
sleepycat 70 sleepycat | sleepycat licen[cs]e
intel 60 intel | intel open source licen[cs]e
apple-apsl-2.0 70 apple public | apple public source licen[cs]e(?: (?:v|version )?2 0)?
nokia 60 nokia | nokia open source licen[cs]e
sun-spl 60 sun public | sun public licen[cs]e
upl-1.0 70 universal permissive | universal permissive licen[cs]e(?: (?:v|version )?1 0)?
mulan-2.0 70 mulan | mulan (?:psl|permissive software licen[cs]e)(?: v?2)?
sspl-1.0 80 server side public | server side public licen[cs]e(?: (?:v|version )?1)?
busl-1.1 80 business source | business source licen[cs]e(?: (?:v|version )?1 1)?
elastic-2.0 80 elastic licen | elastic licen[cs]e(?: (?:v|version )?2 0)?
commons-clause 80 commons clause | commons clause(?: licen[cs]e)?(?: condition)?
rail-m 70 rail | (?:(?:big ?science|creativeml) ?)?open ?rail(?: m)?(?: licen[cs]e)
llama-community 70 community licen | llama [0-9]+(?: [0-9]+)? community licen[cs]e
odbl-1.0 80 open database | open (?:data commons )?open database licen[cs]e(?: (?:v|version )?1 0)?
odbl-1.0 80 open database | open database licen[cs]e
odc-by-1.0 80 open data commons | open data commons attribution licen[cs]e
pddl-1.0 80 public domain dedication | public domain dedication and licen[cs]e
ogl-uk-3.0 80 open government | open government licen[cs]e (?:v|version )?3 0
ogl-uk 60 open government | open government licen[cs]e
cdla-permissive 80 community data | community data licen[cs]e agreement permissive
cdla-sharing 80 community data | community data licen[cs]e agreement sharing
public-domain 60 public domain | (?:in|into|to) the public domain
public-domain 60 public domain | public domain work
public-domain 65 dedicated to | dedicated to the public domain
free-art-1.3 70 free art | free art licen[cs]e(?: 1 3)?
against-drm 60 against drm | against drm licen[cs]e
copyfree 60 copyfree | copyfree licen[cs]e
json 70 good not evil | shall be used for good not evil
fair 60 fair licen | fair licen[cs]e
naist 60 naist | naist licen[cs]e
tcl 60 tcl | tcl tk licen[cs]e
vim 60 vim licen | vim licen[cs]e
info-zip 60 info | info zip licen[cs]e
jpeg-ijg 70 independent jpeg | independent jpeg group
freetype 60 freetype | freetype (?:project )?licen[cs]e
bitstream-vera 60 bitstream | bitstream vera fonts? copyright
spdx-tag 85 spdx | spdx licen[cs]e identifier [^ ]{0,1}[a-z0-9]+
copyleft 40 copyleft | copyleft
all-rights-reserved 50 rights reserved | all rights reserved
copyright-notice 45 copyright | copyright c? ?(?:19|20)[0-9]{2}
copyright-notice 45 copyright | copyright (?:19|20)[0-9]{2} (?:19|20)[0-9]{2}
trademark 40 trademark | registered trademarks? of
patent-notice 45 patent | patents? pending
patent-notice 45 patent | protected by (?:one or more )?(?:u s )?patents?
proprietary 60 proprietary | proprietary licen[cs]e
proprietary 60 proprietary | proprietary and confidential
commercial 60 commercial licen | commercial licen[cs]e
eula 60 end user licen | end user licen[cs]e agreement
shrink-wrap 50 agree | by (?:installing|using) this software you agree
no-warranty 45 warrant | without (?:any )?warrant(?:y|ies)
no-warranty 45 warrant | no warranty
terms-of-use 40 terms of use | subject to (?:the )?terms of use
fair-use 40 fair use | fair use
non-commercial 50 non | (?:for )?non ?commercial (?:use )?only licen[cs]e
royalty-free 45 royalty | royalty free licen[cs]e
free-license 35 licen | free licen[cs]e
open-license 35 licen | open(?: source)? licen[cs]e
dual-license 45 dual | dual licen[cs]ed?
multi-license 45 licen | (?:tri|multi) ?licen[cs]ed
licensed-under 20 licen | licen[cs]ed under(?: the)?
license-terms 20 licen | terms of (?:the|this) licen[cs]e
see-license 20 licen | see (?:the )?licen[cs]e(?: file)?
license-grant 30 licen | (?:hereby )?grants? (?:you )?(?:a )?(?:non exclusive )?(?:worldwide )?licen[cs]e
"""
# fmt: on


def signatures(text: str = _TEXT) -> list[Signature]:
    out = []
    for line in text.strip().splitlines():
        head, pattern = line.split(" | ", 1)
        label, priority, keyword = head.split(" ", 2)
        out.append(Signature(label, int(priority), max(keyword.split(), key=len), over_words(pattern)))
    return out


SIGNATURES = signatures()
_BASE_RULES = [Signature(label, 0, "license" if "license" in phrase else phrase.split()[0], over_words(phrase)) for phrase, label in BASE.items()]


def _lit(rules: list[Signature]) -> Column:
    return F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.keyword).alias("keyword"), F.lit(r.regex).alias("regex")) for r in rules])


_SPAN = "struct<label:string,priority:int,start:int,stop:int>"
#: Elements that are gone through at once; what is found is handed on block by block, so that the work is in proportion to the matches.
_BLOCK = 64


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named inside."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks_of(array: Column) -> Column:
    """The numbers of the blocks of an array."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(array) - 1) / _BLOCK).cast("int")))


def _block(array: Column, number: Column) -> Column:
    return F.transform(F.sequence(number * _BLOCK, F.least(number * _BLOCK + _BLOCK, F.size(array)) - 1), lambda i: F.get(array, i))


def _spans(text: Column, rule: Column) -> Column:
    """All matches of a rule as structs of label, priority, start and end (characters from 0)."""
    kind = f"struct<at:int,found:array<{_SPAN}>>"
    kinds = f"struct<at:int,found:array<array<{_SPAN}>>>"

    def add(state: Column, piece: Column) -> Column:
        shut = F.instr(piece, "\x02")
        span = F.struct(rule["label"].alias("label"), rule["priority"].alias("priority"), state["at"].alias("start"), (state["at"] + shut - 1).alias("stop"))
        at = state["at"] + F.length(piece) - F.when(shut > 0, 1).otherwise(0)
        return F.struct(at.alias("at"), F.when(shut > 0, F.array_append(state["found"], span)).otherwise(state["found"]).alias("found")).cast(kind)

    def add_block(state: Column, block: Column) -> Column:
        own = F.aggregate(block, F.struct(state["at"].alias("at"), F.array().alias("found")).cast(kind), add)
        return _once(own, lambda x: F.struct(x["at"].alias("at"), F.array_append(state["found"], x["found"]).alias("found")).cast(kinds))

    blocks = _once(F.split(F.regexp_replace(text, rule["regex"], F.lit("\x01$0\x02")), "\x01"), lambda pieces: F.transform(_blocks_of(pieces), lambda number: _block(pieces, number)))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(kinds), add_block, lambda s: F.flatten(s["found"]))


def _all_spans(text: Column, rules: Column) -> Column:
    return F.flatten(F.transform(F.filter(rules, lambda r: F.contains(text, r["keyword"])), lambda r: _spans(text, r)))


def surviving(spans: Column) -> Column:
    """Spans that no other label's span of higher priority, or of equal priority and greater length, contains.

    In order of start, and from the longest and the highest priority at one start, whatever contains a span stands before
    it. So spans are swept block by block, and a block is compared with itself and with those before that reach into it.
    """
    of = lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), (-x["priority"]).alias("below"), x["label"].alias("label"))
    back = lambda x: F.struct(x["label"].alias("label"), (-x["below"]).alias("priority"), x["start"].alias("start"), (-x["back"]).alias("stop"))
    kind = "struct<start:int,back:int,below:int,label:string>"
    kinds = f"struct<reach:array<{kind}>,kept:array<array<{kind}>>>"

    def beats(o: Column, s: Column) -> Column:
        """Whether ``o`` contains ``s`` and is above it; in one place, being longer is to start before or stop after."""
        around = (o["label"] != s["label"]) & (o["start"] <= s["start"]) & (o["back"] <= s["back"])
        return around & ((o["below"] < s["below"]) | ((o["below"] == s["below"]) & ((o["start"] < s["start"]) | (o["back"] < s["back"]))))

    def sweep(state: Column, block: Column) -> Column:
        def pooled(pool: Column) -> Column:
            kept = F.filter(block, lambda s: ~F.exists(pool, lambda o: beats(o, s)))
            return _once(F.element_at(block, -1)["start"], lambda last: F.struct(F.filter(pool, lambda o: -o["back"] > last).alias("reach"), F.array_append(state["kept"], kept).alias("kept")).cast(kinds))

        return _once(F.concat(state["reach"], block), pooled)

    none = F.struct(F.array().alias("reach"), F.array().alias("kept")).cast(kinds)
    blocks = _once(F.array_sort(F.transform(spans, of)), lambda ordered: F.transform(_blocks_of(ordered), lambda number: _block(ordered, number)))
    return F.transform(F.aggregate(blocks, none, sweep, lambda s: F.flatten(s["kept"])), back)


def scan(df: DataFrame, rules: list[Signature] = SIGNATURES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row.

    ``spans`` holds the surviving detections; ``score`` is the highest priority among the labels' detections over 100
    (base labels count 60).
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    start = dealt(df.select(F.col(key).alias(key), raw.alias("text"))).select(key, "text", F.lower("text").alias("any_case"))
    gate = None
    for stem in STEMS:
        test = F.contains(F.col("any_case"), F.lit(stem))
        gate = test if gate is None else gate | test
    gated = start.select(key, "text", F.when(gate, F.translate(F.translate(F.col("text"), "\x01\x02", "  "), _UPPER, _LOWER)).alias("low"))
    empty = F.array().cast(f"array<{_SPAN}>")
    none_if = lambda x: F.when(F.col("low").isNotNull(), x).otherwise(empty)
    found = gated.select(key, "text", "low", none_if(_all_spans(F.col("low"), _lit(_BASE_RULES))).alias("base"), none_if(_all_spans(F.col("low"), _lit(rules))).alias("all_spans"))
    kept = found.select(key, "text", "low", "base", F.when(F.size("all_spans") > 0, surviving(F.col("all_spans"))).otherwise(empty).alias("spans"))
    word_at = lambda at: F.regexp_count(F.substr(F.col("low"), F.lit(1), at), F.lit(_ANY_WORD)).cast("long")
    any_base = F.size("base") > 0
    starts = F.transform("base", lambda s: s["start"])
    own = F.array_distinct(F.transform("base", lambda s: s["label"]))
    method = F.array_distinct(F.transform("spans", lambda s: s["label"]))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["priority"])), F.lit(0))
    return kept.select(
        key,
        F.regexp_count(F.col("text"), F.lit(_ANY_WORD)).cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.when(any_base, word_at(F.array_min(starts))).alias("first_word"),
        F.when(any_base, word_at(F.array_max(starts))).alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own, method)), ",").alias("labels"),
        (F.greatest(best, F.when(any_base, 60).otherwise(0)) / 100.0).alias("score"),
        "spans",
    )

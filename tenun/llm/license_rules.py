"""Signatures of licenses and of rights statements, as one table.

A line has a label, a priority, the keywords that gate the rule, and a regular expression
over words in lower case, each followed by one blank. ``@`` stands right before the
keyword, so an expression is tried only where its keyword stands; ``{v}`` is an optional
word for "version". Priority 3 is a text, notice or identifier that names one license and
version, 2 names a license, 1 is a family or a general statement of rights.
"""

from __future__ import annotations

from typing import NamedTuple

BEFORE, AFTER = 10, 22

_SIGNATURES = r"""
mit | 3 | license,licence | (?:the )?mit @licen[cs]e
mit | 3 | expat | @expat (?:mit )?licen[cs]e
mit | 3 | sublicense | copy modify merge publish distribute @sublicense and or sell copies
mit | 3 | spdx | @spdx licen[cs]e identifier mit
mit | 2 | licensed,released,distributed | @(?:licensed|released|distributed) under (?:the )?(?:terms of )?(?:the )?mit
mit | 2 | opensource | @opensource org licenses? mit(?: license)?
mit-0 | 3 | attribution | mit no @attribution
mit-0 | 3 | spdx | @spdx licen[cs]e identifier mit 0
x11 | 3 | x11 | @x11 licen[cs]e
x11 | 3 | consortium | name of the x @consortium shall not be used
apache-1.0 | 3 | apache | @apache (?:software )?licen[cs]e {v}1 0
apache-1.1 | 3 | apache | @apache (?:software )?licen[cs]e {v}1 1
apache-2.0 | 3 | apache | (?:licensed under (?:the )?)?@apache (?:software )?licen[cs]e {v}2(?: 0)?
apache-2.0 | 3 | apache | @apache 2 0(?: licen[cs]e)?
apache-2.0 | 3 | apache | @apache org licenses license 2 0
apache-2.0 | 3 | spdx | @spdx licen[cs]e identifier apache 2 0
apache-2.0 | 3 | apache2,asl2 | @(?:apache2|asl2)(?: 0)?(?: licen[cs]e)?
apache | 2 | apache | @apache (?:software )?licen[cs]e
bsd-0-clause | 3 | 0bsd | @0bsd
bsd-0-clause | 3 | bsd | zero clause @bsd
bsd-1-clause | 3 | bsd | @bsd 1 clause
bsd-2-clause | 3 | bsd | @bsd 2 clause(?: licen[cs]e)?
bsd-2-clause | 3 | bsd | (?:simplified|freebsd|two clause|2 clause) @bsd(?: licen[cs]e)?
bsd-3-clause | 3 | bsd | @bsd 3 clause(?: licen[cs]e)?
bsd-3-clause | 3 | bsd | (?:new|modified|revised|three clause|3 clause) @bsd(?: licen[cs]e)?
bsd-4-clause | 3 | bsd | @bsd 4 clause(?: licen[cs]e)?
bsd-4-clause | 3 | bsd | (?:original|old|four clause|4 clause) @bsd(?: licen[cs]e)?
bsd-4-clause | 3 | acknowledgement | must display the following @acknowledgement
bsd-3-clause | 3 | endorse | contributors may be used to @endorse or promote products
bsd | 2 | redistributions | @redistributions of source code must retain the above copyright notice
bsd | 2 | redistributions | @redistributions in binary form must reproduce the above copyright notice
bsd | 2 | bsd | (?:licensed under (?:the |a )?)?@bsd (?:style )?licen[cs]e
isc | 3 | isc | (?:the )?@isc licen[cs]e
isc | 3 | spdx | @spdx licen[cs]e identifier isc
isc | 3 | fee | use copy modify and or distribute this software for any purpose with or without @fee
gpl-1.0 | 3 | gpl | @gpl {v}1(?: 0)?
gpl-1.0 | 3 | gplv1 | @gplv1
gpl-2.0-only | 3 | gpl | @gpl {v}2(?: 0)? only
gpl-2.0-or-later | 3 | gpl | @gpl {v}2(?: 0)? or (?:any )?later
gpl-2.0 | 3 | gpl | (?:gnu )?@gpl {v}2(?: 0)?
gpl-2.0 | 3 | gplv2,gpl2 | (?:gnu )?@(?:gplv2|gpl2)
gpl-2.0 | 3 | gnu | @gnu general public licen[cs]e {v}2(?: 0)?
gpl-2.0 | 3 | general | (?:gnu )?@general public licen[cs]e as published by the free software foundation (?:either )?version 2
gpl-3.0-only | 3 | gpl | @gpl {v}3(?: 0)? only
gpl-3.0-or-later | 3 | gpl | @gpl {v}3(?: 0)? or (?:any )?later
gpl-3.0 | 3 | gpl | (?:gnu )?@gpl {v}3(?: 0)?
gpl-3.0 | 3 | gplv3,gpl3 | (?:gnu )?@(?:gplv3|gpl3)
gpl-3.0 | 3 | gnu | (?:licensed under the )?@gnu general public licen[cs]e {v}3(?: 0)?
gpl-3.0 | 3 | general | (?:gnu )?@general public licen[cs]e as published by the free software foundation (?:either )?version 3
gpl-any | 2 | gpl | (?:gnu )?@gpl (?:licen[cs]e|licen[cs]ed)
gpl-any | 2 | gnu | @gnu general public licen[cs]e
gpl-classpath | 3 | classpath | (?:gpl with )?@classpath exception
gpl-linking | 3 | linking | (?:special )?exception for @linking|@linking exception
lgpl-2.0 | 3 | lgpl | @lgpl {v}2(?: 0)?
lgpl-2.1 | 3 | lgpl | (?:gnu )?@lgpl {v}2 1(?: or later)?
lgpl-2.1 | 3 | lgplv2 | @lgplv2 1
lgpl-2.1 | 3 | lesser | (?:gnu )?@lesser general public licen[cs]e {v}2 1
lgpl-3.0 | 3 | lgpl | (?:gnu )?@lgpl {v}3(?: 0)?(?: or later)?
lgpl-3.0 | 3 | lgplv3 | @lgplv3
lgpl-3.0 | 3 | lesser | (?:gnu )?@lesser general public licen[cs]e {v}3(?: 0)?
lgpl | 2 | lesser | (?:gnu )?@lesser general public licen[cs]e
lgpl | 2 | library | gnu @library general public licen[cs]e
lgpl | 2 | lgpl | @lgpl(?: licen[cs]ed?)?
agpl-1.0 | 3 | affero | @affero general public licen[cs]e {v}1(?: 0)?
agpl-3.0 | 3 | affero | (?:gnu )?@affero general public licen[cs]e {v}3(?: 0)?
agpl-3.0 | 3 | agpl | @agpl {v}3(?: 0)?(?: or later)?
agpl-3.0 | 3 | agplv3 | @agplv3
agpl | 2 | affero | (?:gnu )?@affero general public licen[cs]e
agpl | 2 | agpl | @agpl(?: licen[cs]ed?)?
gfdl-1.1 | 3 | documentation | (?:gnu )?free @documentation licen[cs]e {v}1 1
gfdl-1.2 | 3 | documentation | (?:gnu )?free @documentation licen[cs]e {v}1 2
gfdl-1.3 | 3 | documentation | (?:gnu )?free @documentation licen[cs]e {v}1 3
gfdl | 2 | documentation | (?:gnu )?free @documentation licen[cs]e
gfdl | 2 | gfdl | @gfdl
mpl-1.0 | 3 | mozilla | @mozilla public licen[cs]e {v}1 0
mpl-1.1 | 3 | mozilla | @mozilla public licen[cs]e {v}1 1
mpl-1.1 | 3 | mpl | @mpl {v}1 1
mpl-2.0 | 3 | mozilla | @mozilla public licen[cs]e {v}2(?: 0)?
mpl-2.0 | 3 | mpl | @mpl {v}2(?: 0)?
mpl-2.0 | 3 | mozilla | subject to the terms of the @mozilla public licen[cs]e v 2 0
mpl | 2 | mozilla | @mozilla public licen[cs]e
npl | 2 | netscape | @netscape public licen[cs]e
epl-1.0 | 3 | eclipse | @eclipse public licen[cs]e {v}1(?: 0)?
epl-1.0 | 3 | epl | @epl {v}1 0
epl-2.0 | 3 | eclipse | @eclipse public licen[cs]e {v}2(?: 0)?
epl-2.0 | 3 | epl | @epl {v}2 0
epl | 2 | eclipse | @eclipse public licen[cs]e
edl-1.0 | 3 | eclipse | @eclipse distribution licen[cs]e
cpl-1.0 | 3 | common | @common public licen[cs]e
cddl-1.0 | 3 | cddl | @cddl {v}1 0
cddl-1.1 | 3 | cddl | @cddl {v}1 1
cddl | 2 | cddl | @cddl(?: licen[cs]e)?
cddl | 2 | common | @common development and distribution licen[cs]e
ipl-1.0 | 3 | ibm | @ibm public licen[cs]e
qpl-1.0 | 3 | q | the @q public licen[cs]e
sleepycat | 3 | sleepycat | @sleepycat (?:software )?licen[cs]e
postgresql | 3 | postgresql | @postgresql licen[cs]e
python-2.0 | 3 | python | @python (?:software foundation )?licen[cs]e(?: version)?(?: 2)?(?: 0)?
php-3.01 | 3 | php | (?:the )?@php licen[cs]e {v}3 01
php | 2 | php | (?:the )?@php licen[cs]e
ruby | 2 | ruby | @ruby licen[cs]e
artistic-1.0 | 3 | artistic | @artistic licen[cs]e {v}1(?: 0)?
artistic-2.0 | 3 | artistic | @artistic licen[cs]e {v}2(?: 0)?
artistic | 2 | artistic | (?:the )?@artistic licen[cs]e
zlib | 3 | zlib | (?:the )?@zlib (?:libpng )?licen[cs]e
zlib | 3 | misrepresented | origin of this software must not be @misrepresented
libpng | 3 | libpng | @libpng licen[cs]e
openssl | 3 | openssl | @openssl licen[cs]e
ssleay | 3 | ssleay | @ssleay licen[cs]e
curl | 3 | curl | @curl licen[cs]e
icu | 3 | icu | @icu licen[cs]e
unicode-dfs | 3 | unicode | @unicode (?:data files|terms of use|licen[cs]e)
ncsa | 3 | ncsa | (?:university of illinois )?@ncsa open source licen[cs]e
w3c | 3 | w3c | @w3c (?:software )?(?:notice and )?licen[cs]e
ofl-1.1 | 3 | sil | @sil open font licen[cs]e {v}1 1
ofl-1.1 | 3 | ofl | @ofl {v}1 1
ofl | 2 | font | (?:sil )?open @font licen[cs]e
boost-1.0 | 3 | boost | @boost software licen[cs]e(?: version 1 0| 1 0)?
bsl-1.1 | 3 | busl | @busl {v}1 1
bsl-1.1 | 3 | business | @business source licen[cs]e(?: version 1 1| 1 1)?
sspl-1.0 | 3 | sspl | @sspl(?: {v}1(?: 0)?)?
sspl-1.0 | 3 | server | @server side public licen[cs]e
elastic-2.0 | 3 | elastic | @elastic licen[cs]e {v}2(?: 0)?
elastic | 2 | elastic | @elastic licen[cs]e
confluent | 3 | confluent | @confluent community licen[cs]e
commons-clause | 3 | commons | @commons clause (?:licen[cs]e )?condition
commons-clause | 2 | commons | @commons clause
polyform | 2 | polyform | @polyform (?:noncommercial|small business|shield|perimeter|strict)(?: licen[cs]e)?
prosperity | 3 | prosperity | (?:the )?@prosperity public licen[cs]e
parity | 3 | parity | (?:the )?@parity public licen[cs]e
hippocratic | 3 | hippocratic | @hippocratic licen[cs]e
json | 3 | json | @json licen[cs]e
json | 3 | evil | software shall be used for good not @evil
beerware | 3 | beerware | @beerware(?: licen[cs]e)?
beerware | 3 | beer | you can buy me a @beer in return
wtfpl | 3 | wtfpl | @wtfpl(?: {v}2)?
wtfpl | 3 | fuck | do what the @fuck you want to public licen[cs]e
unlicense | 3 | unlicense | (?:the )?@unlicense
unlicense | 3 | unencumbered | free and @unencumbered software released into the public domain
eupl-1.0 | 3 | eupl | @eupl {v}1 0
eupl-1.1 | 3 | eupl | @eupl {v}1 1
eupl-1.2 | 3 | eupl | @eupl {v}1 2
eupl | 2 | eupl | @eupl
eupl | 2 | union | european @union public licen[cs]e
cecill-2.1 | 3 | cecill | @cecill {v}2 1
cecill-b | 3 | cecill | @cecill b
cecill-c | 3 | cecill | @cecill c
cecill | 2 | cecill | (?:licence )?@cecill
mulan-psl-2.0 | 3 | mulan | @mulan (?:psl|permissive software licen[cs]e) {v}2
mulan-psl | 2 | mulan | @mulan (?:psl|permissive software licen[cs]e)
ms-pl | 3 | microsoft | @microsoft public licen[cs]e
ms-rl | 3 | reciprocal | microsoft @reciprocal licen[cs]e
apsl-2.0 | 3 | apple | @apple public source licen[cs]e(?: version 2 0| 2 0)?
afl-3.0 | 3 | academic | @academic free licen[cs]e(?: version 3 0| {v}3 0)?
osl-3.0 | 3 | osl | @osl {v}3 0
osl | 2 | open | @open software licen[cs]e
ecl-2.0 | 3 | educational | @educational community licen[cs]e(?: version 2 0| 2 0)?
upl-1.0 | 3 | universal | @universal permissive licen[cs]e
rpl-1.5 | 3 | reciprocal | @reciprocal public licen[cs]e
lppl-1.3 | 3 | latex | @latex project public licen[cs]e
lppl-1.3 | 3 | lppl | @lppl(?: {v}1 3c?)?
vim | 3 | vim | @vim licen[cs]e
zpl-2.1 | 3 | zope | @zope public licen[cs]e
aal | 3 | assurance | attribution @assurance licen[cs]e
watcom | 3 | watcom | sybase open @watcom public licen[cs]e
nokia | 3 | nokia | @nokia open source licen[cs]e
intel | 3 | intel | @intel open source licen[cs]e
blueoak | 3 | oak | blue @oak model licen[cs]e
bigscience-rail | 3 | bigscience | @bigscience (?:bloom )?(?:open )?rail
openrail-m | 3 | openrail | (?:creativeml )?@openrail m
openrail | 2 | openrail | (?:creativeml )?@openrail
llama-community | 3 | llama | @llama (?:2 |3 |3 1 |3 2 )?community licen[cs]e
gemma-terms | 3 | gemma | @gemma terms of use
ai2-impact | 3 | impact | ai2 @impact licen[cs]e
cc0-1.0 | 3 | cc0 | @cc0 {v}1 0(?: universal)?
cc0-1.0 | 3 | zero | creative commons @zero {v}1 0
cc0 | 2 | cc0 | @cc0
cc0 | 2 | publicdomain | @publicdomain zero 1 0
cc-by-1.0 | 3 | cc | @cc by {v}1 0
cc-by-2.0 | 3 | cc | @cc by {v}2 0
cc-by-2.5 | 3 | cc | @cc by {v}2 5
cc-by-3.0 | 3 | cc | @cc by {v}3 0
cc-by-4.0 | 3 | cc | @cc by {v}4 0
cc-by-sa-2.0 | 3 | cc | @cc by sa {v}2 0
cc-by-sa-2.5 | 3 | cc | @cc by sa {v}2 5
cc-by-sa-3.0 | 3 | cc | @cc by sa {v}3 0
cc-by-sa-4.0 | 3 | cc | @cc by sa {v}4 0
cc-by-nd-3.0 | 3 | cc | @cc by nd {v}3 0
cc-by-nd-4.0 | 3 | cc | @cc by nd {v}4 0
cc-by-nc-3.0 | 3 | cc | (?:licensed under )?@cc by nc {v}3 0
cc-by-nc-4.0 | 3 | cc | (?:licensed under )?@cc by nc {v}4 0
cc-by-nc-sa-3.0 | 3 | cc | @cc by nc sa {v}3 0
cc-by-nc-sa-4.0 | 3 | cc | @cc by nc sa {v}4 0
cc-by-nc-nd-3.0 | 3 | cc | @cc by nc nd {v}3 0
cc-by-nc-nd-4.0 | 3 | cc | @cc by nc nd {v}4 0
cc-by-sa | 2 | cc | @cc by sa
cc-by-nd | 2 | cc | @cc by nd
cc-by-nc | 2 | cc | @cc by nc
cc-by-nc-sa | 2 | cc | @cc by nc sa
cc-by-nc-nd | 2 | cc | @cc by nc nd
cc-by-4.0 | 3 | creativecommons | @creativecommons org licenses by 4 0
cc-by-3.0 | 3 | creativecommons | @creativecommons org licenses by 3 0
cc-by-sa-4.0 | 3 | creativecommons | @creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | 3 | creativecommons | @creativecommons org licenses by sa 3 0
cc-by-nd-4.0 | 3 | creativecommons | @creativecommons org licenses by nd 4 0
cc-by-nc-4.0 | 3 | creativecommons | @creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | 3 | creativecommons | @creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 3 | creativecommons | @creativecommons org licenses by nc nd 4 0
cc0-1.0 | 3 | creativecommons | @creativecommons org publicdomain zero 1 0
cc-by-sa | 2 | sharealike | creative commons attribution (?:share alike|@sharealike)
cc-by-nc | 2 | noncommercial | creative commons attribution (?:non commercial|@noncommercial)
cc-by-nd | 2 | noderivatives,noderivs | creative commons attribution @(?:noderivatives|noderivs)
cc-by | 2 | creative | @creative commons attribution(?: licen[cs]e)?
cc | 1 | creative | @creative commons(?: licen[cs]e)?
cc | 1 | creativecommons | @creativecommons org licenses
odbl-1.0 | 3 | odbl | @odbl(?: {v}1 0)?
odbl-1.0 | 3 | database | open (?:data commons open )?@database licen[cs]e
odc-by-1.0 | 3 | odc | @odc (?:by|attribution)(?: licen[cs]e)?
pddl-1.0 | 3 | pddl | @pddl(?: {v}1 0)?
cdla-permissive | 3 | cdla | @cdla permissive(?: 1 0| 2 0)?
cdla-sharing | 3 | cdla | @cdla sharing(?: 1 0)?
ogl-uk-3.0 | 3 | government | open @government licen[cs]e(?: {v}3 0)?
etalab-2.0 | 3 | etalab | (?:licence ouverte )?@etalab 2 0
etalab | 2 | ouverte | @licence ouverte|licence @ouverte
dl-de-by | 3 | datenlizenz | @datenlizenz deutschland
fal-1.3 | 3 | art | free @art licen[cs]e|licence @art libre
public-domain | 2 | domain | (?:released |dedicated )?(?:in|into|to) the public @domain
public-domain | 1 | domain | public @domain
gemeinfrei | 1 | gemeinfrei | (?:ist |sind )?@gemeinfrei
copyright | 1 | copyright | @copyright (?:c )?(?:19|20)[0-9][0-9]
copyright | 1 | copyright | @copyright (?:c|holders?|owners?|notice)
copyleft | 1 | copyleft | @copyleft
reserved | 1 | reservados | todos los derechos @reservados
reserved | 1 | vorbehalten | alle rechte @vorbehalten
reserved | 1 | réservés | tous droits @réservés
proprietary | 2 | proprietary | @proprietary and confidential|confidential and @proprietary
proprietary | 1 | proprietary | @proprietary (?:licen[cs]e|software|information)
non-commercial | 2 | noncommercial | @noncommercial (?:use|purposes?)(?: only)?
non-commercial | 2 | commercial | (?:not for|for non|non) @commercial (?:use|purposes?)(?: only)?
research-only | 2 | research | for @research (?:purposes|use) only
no-derivatives | 1 | derivative | no @derivative works
no-redistribution | 2 | redistributed | may not be (?:copied |reproduced |published )*(?:or )?@redistributed
no-redistribution | 2 | reproduced | may (?:not )?be @reproduced (?:in any form )?without (?:the )?(?:prior )?(?:written )?permission
no-text-mining | 2 | mining | (?:text and data|text or data|data) @mining (?:is |are )?(?:prohibited|not permitted|reserved)
no-ai-training | 2 | training | (?:may )?not (?:be )?used? for (?:the )?@training (?:of )?(?:ai|machine|artificial|language)
terms-of-use | 1 | terms | subject to (?:the |our )?@terms (?:of (?:use|service)|and conditions)
permission-notice | 1 | permission | @permission is hereby granted free of charge
warranty-disclaimer | 1 | warranty,warranties | without (?:any )?@warrant(?:y|ies) (?:of any kind|express or implied)
warranty-disclaimer | 1 | merchantability | (?:implied )?warrant(?:y|ies) of @merchantability
patent-grant | 1 | patent | @patent (?:grant|licen[cs]e)
trademark | 1 | trademark,trademarks | (?:registered )?@trademarks? of
eula | 2 | end | @end user licen[cs]e agreement
eula | 2 | eula | @eula
dual-license | 1 | dual | @dual (?:licen[cs]ed|licen[cs]e)
open-source | 1 | open | (?:under an )?@open source licen[cs]e
dmca | 1 | dmca | @dmca (?:notice|takedown)
dmca | 1 | millennium | digital @millennium copyright act
"""


class Rule(NamedTuple):
    """A signature: ``pattern`` holds ``@`` before ``keyword``; base rules keep their label whatever contains them."""

    label: str
    priority: int
    keyword: str
    pattern: str
    base: bool = False


#: Phrases whose every place counts, with their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


def phrase_rule(phrase: str, label: str, keyword: str | None = None) -> Rule:
    """A base rule: the words of ``phrase`` one after the other, gated by its first word unless another one is named."""
    words = phrase.split()
    at = words.index(keyword) if keyword else 0
    return Rule(label, 1, words[at], " ".join([*words[:at], "@" + words[at], *words[at + 1 :]]), True)


def signature_rules() -> list[Rule]:
    """The table above, a rule for each keyword, in order."""
    rules = []
    for line in _SIGNATURES.strip().splitlines():
        label, priority, keywords, pattern = line.split(" | ", 3)
        rules += [Rule(label, int(priority), keyword, pattern.replace("{v}", "(?:(?:version|ver|v) )?")) for keyword in keywords.split(",")]
    return rules


def all_rules() -> list[Rule]:
    return [phrase_rule(phrase, label, {"reserved": "reserved"}.get(label)) for phrase, label in BASE_PHRASES] + signature_rules()

"""License scans by ordered signature rules.

A rule is (label, priority, keyword, pattern).  Patterns are regular expressions over words: a space stands for any
separators, both ends are word boundaries.  They allow for spelling (license, licence), ways to write a version (version 2, v2, 2.0),
articles that may be missing, and words written together or apart.  A rule's pattern runs only on texts that hold its keyword, the
longest run of letters that every match has.  Detections of one text are resolved in order of priority (lower
first), then length, then place: a detection that lies inside an earlier one is dropped.  Notices (priority 1), full
names (2), identifiers and addresses (3) and hints (4) are written by hand, license by license.

The phrases of ``BASE`` are counted as well wherever they stand; their labels always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytewords import ALNUM, chunks, spans
from .common import small_batches

#: Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label ; notices ; names ; identifiers and addresses; a slash between patterns.
SIGNATURES = r"""
mit ; licen[cs]ed under (?:the )?mit licen[cs]e / released under (?:the )?mit licen[cs]e / permission is hereby granted free of charge to any person obtaining a copy ; the mit licen[cs]e / mit licen[cs]e / expat licen[cs]e ; spdx licen[cs]e identifier mit / open ?source org licen[cs]es mit / licen[cs]e mit
mit-0 ; mit no attribution licen[cs]e ; mit no attribution ; spdx licen[cs]e identifier mit 0
x11 ; x11 consortium licen[cs]e ; x11 licen[cs]e ; spdx licen[cs]e identifier x11
apache-2 ; licen[cs]ed under (?:the )?apache licen[cs]e v(?:er(?:sion)?)? ?2(?: 0)? / licen[cs]ed under (?:the )?apache licen[cs]e 2 0 ; apache licen[cs]e v(?:er(?:sion)?)? ?2(?: 0)? / apache licen[cs]e 2 0 / apache software licen[cs]e 2 0 ; spdx licen[cs]e identifier apache 2 0 / apache org licen[cs]es licen[cs]e 2 0 / licen[cs]e apache 2 0
apache-1.1 ; licen[cs]ed under (?:the )?apache software licen[cs]e v(?:er(?:sion)?)? ?1 1 ; apache software licen[cs]e v(?:er(?:sion)?)? ?1 1 / apache licen[cs]e 1 1 ; spdx licen[cs]e identifier apache 1 1
apache-1.0 ; apache group licen[cs]e v(?:er(?:sion)?)? ?1 0 ; apache licen[cs]e 1 0 / apache software licen[cs]e v(?:er(?:sion)?)? ?1 0 ; spdx licen[cs]e identifier apache 1 0
gpl-3 ; licen[cs]ed under (?:the )?gnu general public licen[cs]e v(?:er(?:sion)?)? ?3 / gnu general public licen[cs]e as published by (?:the )?free software foundation either v(?:er(?:sion)?)? ?3 ; gnu general public licen[cs]e v(?:er(?:sion)?)? ?3 / gnu general public licen[cs]e v(?:er(?:sion)?)? ?3 / gnu gpl v(?:er(?:sion)?)? ?3 ; spdx licen[cs]e identifier gpl 3 0 / gnu org licen[cs]es gpl 3 0
gpl-2 ; licen[cs]ed under (?:the )?gnu general public licen[cs]e v(?:er(?:sion)?)? ?2 / gnu general public licen[cs]e as published by (?:the )?free software foundation either v(?:er(?:sion)?)? ?2 ; gnu general public licen[cs]e v(?:er(?:sion)?)? ?2 / gnu general public licen[cs]e v(?:er(?:sion)?)? ?2 / gnu gpl v(?:er(?:sion)?)? ?2 ; spdx licen[cs]e identifier gpl 2 0 / gnu org licen[cs]es gpl 2 0
gpl-1 ; gnu general public licen[cs]e as published by (?:the )?free software foundation either v(?:er(?:sion)?)? ?1 ; gnu general public licen[cs]e v(?:er(?:sion)?)? ?1 ; spdx licen[cs]e identifier gpl 1 0
gpl ; licen[cs]ed under (?:the )?gnu general public licen[cs]e / terms of (?:the )?gnu general public licen[cs]e ; gnu general public licen[cs]e / general public licen[cs]e ; gnu org licen[cs]es gpl
lgpl-3 ; licen[cs]ed under (?:the )?gnu lesser general public licen[cs]e v(?:er(?:sion)?)? ?3 ; gnu lesser general public licen[cs]e v(?:er(?:sion)?)? ?3 / gnu lgpl v(?:er(?:sion)?)? ?3 ; spdx licen[cs]e identifier lgpl 3 0 / gnu org licen[cs]es lgpl 3 0
lgpl-2.1 ; licen[cs]ed under (?:the )?gnu lesser general public licen[cs]e v(?:er(?:sion)?)? ?2 1 ; gnu lesser general public licen[cs]e v(?:er(?:sion)?)? ?2 1 ; spdx licen[cs]e identifier lgpl 2 1 / gnu org licen[cs]es lgpl 2 1
lgpl-2 ; gnu library general public licen[cs]e as published ; gnu library general public licen[cs]e v(?:er(?:sion)?)? ?2 / gnu library general public licen[cs]e ; spdx licen[cs]e identifier lgpl 2 0
lgpl ; terms of (?:the )?gnu lesser general public licen[cs]e ; gnu lesser general public licen[cs]e ; gnu org licen[cs]es lgpl
agpl-3 ; licen[cs]ed under (?:the )?gnu affero general public licen[cs]e v(?:er(?:sion)?)? ?3 / gnu affero general public licen[cs]e as published ; gnu affero general public licen[cs]e v(?:er(?:sion)?)? ?3 / affero gpl v(?:er(?:sion)?)? ?3 ; spdx licen[cs]e identifier agpl 3 0 / gnu org licen[cs]es agpl 3 0
agpl ; terms of (?:the )?gnu affero general public licen[cs]e ; gnu affero general public licen[cs]e / affero general public licen[cs]e ; gnu org licen[cs]es agpl
gfdl ; permission is granted to copy distribute and or modify this document under (?:the )?terms of (?:the )?gnu free documentation licen[cs]e ; gnu free documentation licen[cs]e ; spdx licen[cs]e identifier gfdl / gnu org licen[cs]es fdl
bsd-3-clause ; licen[cs]ed under (?:the )?bsd 3 clause licen[cs]e / licen[cs]ed under (?:the )?3 clause bsd licen[cs]e ; bsd 3 clause licen[cs]e / 3 clause bsd licen[cs]e / new bsd licen[cs]e / modified bsd licen[cs]e ; spdx licen[cs]e identifier bsd 3 clause / open ?source org licen[cs]es bsd 3 clause
bsd-2-clause ; licen[cs]ed under (?:the )?bsd 2 clause licen[cs]e / licen[cs]ed under (?:the )?2 clause bsd licen[cs]e ; bsd 2 clause licen[cs]e / 2 clause bsd licen[cs]e / simplified bsd licen[cs]e / freebsd licen[cs]e ; spdx licen[cs]e identifier bsd 2 clause / open ?source org licen[cs]es bsd 2 clause
bsd-4-clause ; licen[cs]ed under (?:the )?bsd 4 clause licen[cs]e ; bsd 4 clause licen[cs]e / original bsd licen[cs]e ; spdx licen[cs]e identifier bsd 4 clause
0bsd ; zero clause bsd licen[cs]e terms ; zero clause bsd / bsd zero clause licen[cs]e ; spdx licen[cs]e identifier 0bsd
bsd ; licen[cs]ed under (?:the )?bsd licen[cs]e / released under a bsd style licen[cs]e ; bsd licen[cs]e / bsd style licen[cs]e ; licen[cs]e bsd
bsd-clauses ; redistribution and use in source and binary forms with or without modification are permitted ; redistributions of source code must retain the above copyright notice ; redistributions in binary form must reproduce the above copyright notice
isc ; licen[cs]ed under (?:the )?isc licen[cs]e ; isc licen[cs]e ; spdx licen[cs]e identifier isc / open ?source org licen[cs]es isc
isc-grant ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted ; the software is provided as is and the author disclaims all warranties ; permission to use copy modify and distribute this software
mpl-2 ; this source code form is subject to (?:the )?terms of (?:the )?mozilla public licen[cs]e v(?:er(?:sion)?)? ?2 0 / licen[cs]ed under (?:the )?mozilla public licen[cs]e v(?:er(?:sion)?)? ?2 0 ; mozilla public licen[cs]e v(?:er(?:sion)?)? ?2 0 / mozilla public licen[cs]e 2 0 ; spdx licen[cs]e identifier mpl 2 0 / mozilla org mpl 2 0
mpl-1.1 ; subject to (?:the )?mozilla public licen[cs]e v(?:er(?:sion)?)? ?1 1 ; mozilla public licen[cs]e v(?:er(?:sion)?)? ?1 1 ; spdx licen[cs]e identifier mpl 1 1
mpl ; terms of (?:the )?mozilla public licen[cs]e ; mozilla public licen[cs]e ; mozilla org mpl
epl-2 ; under (?:the )?terms of (?:the )?eclipse public licen[cs]e 2 0 ; eclipse public licen[cs]e v(?:er(?:sion)?)? ?2 0 / eclipse public licen[cs]e v(?:er(?:sion)?)? ?2 0 ; spdx licen[cs]e identifier epl 2 0
epl-1 ; under (?:the )?terms of (?:the )?eclipse public licen[cs]e v(?:er(?:sion)?)? ?1 0 ; eclipse public licen[cs]e v(?:er(?:sion)?)? ?1 0 / eclipse public licen[cs]e v(?:er(?:sion)?)? ?1 0 ; spdx licen[cs]e identifier epl 1 0
edl ; under (?:the )?eclipse distribution licen[cs]e ; eclipse distribution licen[cs]e ; eclipse org org documents edl v10
cddl ; subject to (?:the )?terms of (?:the )?common development and distribution licen[cs]e ; common development and distribution licen[cs]e ; spdx licen[cs]e identifier cddl
cpl ; under (?:the )?terms of (?:the )?common public licen[cs]e ; common public licen[cs]e v(?:er(?:sion)?)? ?1 0 ; spdx licen[cs]e identifier cpl 1 0
cpal ; under (?:the )?common public attribution licen[cs]e ; common public attribution licen[cs]e ; spdx licen[cs]e identifier cpal 1 0
artistic-2 ; under (?:the )?artistic licen[cs]e 2 0 ; artistic licen[cs]e 2 0 / artistic licen[cs]e v(?:er(?:sion)?)? ?2 0 ; spdx licen[cs]e identifier artistic 2 0
artistic ; under (?:the )?terms of (?:the )?artistic licen[cs]e ; artistic licen[cs]e / clarified artistic licen[cs]e ; spdx licen[cs]e identifier artistic
perl ; same terms as perl itself / under (?:the )?same terms as perl ; perl artistic licen[cs]e ; dev perl org licen[cs]es
python-2 ; python software foundation licen[cs]e agreement ; python software foundation licen[cs]e / psf licen[cs]e ; spdx licen[cs]e identifier python 2 0
php-3 ; this source file is subject to v(?:er(?:sion)?)? ?3 01 of (?:the )?php licen[cs]e ; the php licen[cs]e v(?:er(?:sion)?)? ?3 / php licen[cs]e ; spdx licen[cs]e identifier php 3
ruby ; under (?:the )?same terms as ruby ; ruby licen[cs]e ; spdx licen[cs]e identifier ruby
zlib ; this software is provided as is without any express or implied warranty in no event will the authors be held liable ; zlib licen[cs]e / zlib libpng licen[cs]e ; spdx licen[cs]e identifier zlib
libpng ; this code is released under (?:the )?libpng licen[cs]e ; libpng licen[cs]e ; spdx licen[cs]e identifier libpng
boost-1 ; distributed under (?:the )?boost software licen[cs]e v(?:er(?:sion)?)? ?1 0 ; boost software licen[cs]e v(?:er(?:sion)?)? ?1 0 / boost software licen[cs]e ; spdx licen[cs]e identifier bsl 1 0 / boost org licen[cs]e 1 0
unlicense ; this is free and unencumbered software released into the public domain ; the unlicense ; spdx licen[cs]e identifier unlicense / unlicense org
wtfpl ; licen[cs]ed under (?:the )?wtfpl ; wtfpl licen[cs]e ; spdx licen[cs]e identifier wtfpl / wtfpl net
cc0 ; dedicated to (?:the )?public domain under cc0 / to (?:the )?extent possible under law the author has waived all copyright ; cc0 1 0 universal / cc0 1 0 ; spdx licen[cs]e identifier cc0 1 0 / creativecommons org publicdomain zero 1 0
cc-by-nc-nd ; licen[cs]ed under cc by nc nd / attribution non ?commercial no ?derivatives 4 0 international licen[cs]e ; creative commons attribution non ?commercial no ?derivatives / creative commons attribution non ?commercial no derivatives ; cc by nc nd / creativecommons org licen[cs]es by nc nd
cc-by-nc-sa ; licen[cs]ed under cc by nc sa / attribution non ?commercial share ?alike 4 0 international licen[cs]e ; creative commons attribution non ?commercial share ?alike / creative commons attribution non ?commercial share alike ; cc by nc sa / creativecommons org licen[cs]es by nc sa
cc-by-nc ; licen[cs]ed under cc by nc / attribution non ?commercial 4 0 international licen[cs]e ; creative commons attribution non ?commercial / creative commons attribution non ?commercial ; cc by nc / creativecommons org licen[cs]es by nc
cc-by-nd ; licen[cs]ed under cc by nd / attribution no ?derivatives 4 0 international licen[cs]e ; creative commons attribution no ?derivatives / creative commons attribution no derivatives ; cc by nd / creativecommons org licen[cs]es by nd
cc-by-sa ; licen[cs]ed under cc by sa / attribution share ?alike 4 0 international licen[cs]e ; creative commons attribution share ?alike / creative commons attribution share alike ; cc by sa / creativecommons org licen[cs]es by sa
cc-by ; licen[cs]ed under cc by 4 0 / licen[cs]ed under a creative commons attribution 4 0 ; creative commons attribution 4 0 / creative commons attribution licen[cs]e / creative commons attribution ; cc by 4 0 / cc by 3 0 / creativecommons org licen[cs]es by
creative-commons ; licen[cs]ed under a creative commons licen[cs]e ; creative commons licen[cs]e ; creativecommons org licen[cs]es
public-domain ; this work is in the public domain / released into the public domain ; public domain dedication / public domain mark ; creativecommons org publicdomain
openssl ; under (?:the )?openssl licen[cs]e ; openssl licen[cs]e ; spdx licen[cs]e identifier openssl
curl ; licen[cs]ed under (?:the )?curl licen[cs]e ; curl licen[cs]e ; spdx licen[cs]e identifier curl
postgresql ; released under (?:the )?postgresql licen[cs]e ; postgresql licen[cs]e ; spdx licen[cs]e identifier postgresql
ncsa ; university of illinois ncsa open ?source licen[cs]e ; illinois ncsa open ?source licen[cs]e ; spdx licen[cs]e identifier ncsa
eupl-1.2 ; licen[cs]ed under (?:the )?eupl v(?:er(?:sion)?)? ?1 2 ; european union public licen[cs]e v(?:er(?:sion)?)? ?1 2 / european union public licen[cs]e 1 2 ; spdx licen[cs]e identifier eupl 1 2
eupl ; licen[cs]ed under (?:the )?european union public licen[cs]e ; european union public licen[cs]e / european union public licen[cs]e ; joinup ec europa eu collection eupl
cecill ; governed by (?:the )?cecill licen[cs]e ; cecill licen[cs]e ; spdx licen[cs]e identifier cecill
ofl-1.1 ; licen[cs]ed under (?:the )?sil open font licen[cs]e v(?:er(?:sion)?)? ?1 1 ; sil open font licen[cs]e / open font licen[cs]e 1 1 ; spdx licen[cs]e identifier ofl 1 1 / scripts sil org ofl
ofl-name ; this font software is licen[cs]ed under (?:the )?sil open font licen[cs]e ; sil open font licen[cs]e v(?:er(?:sion)?)? ?1 1 ; open font licen[cs]e
afl-3 ; licen[cs]ed under (?:the )?academic free licen[cs]e v(?:er(?:sion)?)? ?3 0 ; academic free licen[cs]e 3 0 / academic free licen[cs]e ; spdx licen[cs]e identifier afl 3 0
osl-3 ; licen[cs]ed under (?:the )?open software licen[cs]e v(?:er(?:sion)?)? ?3 0 ; open software licen[cs]e 3 0 ; spdx licen[cs]e identifier osl 3 0
ms-pl ; this licen[cs]e governs use of (?:the )?accompanying software microsoft public licen[cs]e ; microsoft public licen[cs]e ; spdx licen[cs]e identifier ms pl
ms-rl ; under (?:the )?microsoft reciprocal licen[cs]e ; microsoft reciprocal licen[cs]e ; spdx licen[cs]e identifier ms rl
odbl ; made available under (?:the )?open database licen[cs]e ; open database licen[cs]e / open data commons open database licen[cs]e ; spdx licen[cs]e identifier odbl 1 0 / opendatacommons org licen[cs]es odbl
odc-by ; made available under (?:the )?open data commons attribution licen[cs]e ; open data commons attribution licen[cs]e ; spdx licen[cs]e identifier odc by 1 0 / opendatacommons org licen[cs]es by
pddl ; made available under (?:the )?public domain dedication and licen[cs]e ; public domain dedication and licen[cs]e ; spdx licen[cs]e identifier pddl 1 0 / opendatacommons org licen[cs]es pddl
cdla-permissive ; community data licen[cs]e agreement permissive v(?:er(?:sion)?)? ?2 0 ; community data licen[cs]e agreement permissive ; spdx licen[cs]e identifier cdla permissive
cdla-sharing ; community data licen[cs]e agreement sharing v(?:er(?:sion)?)? ?1 0 ; community data licen[cs]e agreement sharing ; spdx licen[cs]e identifier cdla sharing
ogl-uk ; contains public sector information licen[cs]ed under (?:the )?open government licen[cs]e ; open government licen[cs]e v(?:er(?:sion)?)? ?3 0 / open government licen[cs]e ; nationalarchives gov uk doc open government licen[cs]e
sspl ; subject to (?:the )?server side public licen[cs]e ; server side public licen[cs]e ; spdx licen[cs]e identifier sspl 1 0
elastic-2 ; licen[cs]ed under (?:the )?elastic licen[cs]e 2 0 ; elastic licen[cs]e 2 0 / elastic licen[cs]e ; spdx licen[cs]e identifier elastic 2 0
busl-1.1 ; use of this software is governed by (?:the )?business source licen[cs]e ; business source licen[cs]e 1 1 / business source licen[cs]e ; spdx licen[cs]e identifier busl 1 1
polyform ; licen[cs]ed under (?:the )?polyform non ?commercial licen[cs]e ; polyform non ?commercial licen[cs]e / polyform small business licen[cs]e ; polyformproject org licen[cs]es
commons-clause ; commons clause licen[cs]e condition v(?:er(?:sion)?)? ?1 0 ; commons clause ; commonsclause com
openrail ; licen[cs]ed under (?:the )?openrail licen[cs]e ; bigscience openrail m / creativeml open rail m ; openrail m licen[cs]e
llama ; licen[cs]ed under (?:the )?llama community licen[cs]e ; llama 2 community licen[cs]e agreement / llama 3 community licen[cs]e agreement ; meta llama licen[cs]e
gemma ; gemma is provided under and subject to (?:the )?gemma terms of use ; gemma terms of use ; ai google dev gemma terms
w3c ; w3c software and document notice and licen[cs]e ; w3c software notice and licen[cs]e ; spdx licen[cs]e identifier w3c
icu ; icu licen[cs]e icu 1 8 1 and later ; icu licen[cs]e ; spdx licen[cs]e identifier icu
unicode ; unicode inc licen[cs]e agreement data files and software ; unicode licen[cs]e agreement ; spdx licen[cs]e identifier unicode dfs 2016
vim ; vim licen[cs]e terms ; vim licen[cs]e ; spdx licen[cs]e identifier vim
tcl ; tcl tk licen[cs]e terms ; tcl tk licen[cs]e ; spdx licen[cs]e identifier tcl
sleepycat ; sleepycat licen[cs]e terms ; sleepycat licen[cs]e ; spdx licen[cs]e identifier sleepycat
beerware ; the beer ware licen[cs]e revision 42 ; beerware licen[cs]e ; spdx licen[cs]e identifier beerware
proprietary ; all rights reserved unauthorized copying of this file is strictly prohibited ; proprietary and confidential all rights reserved ; confidential all rights reserved
all-rights-reserved ; all rights reserved no part of this publication may be reproduced ; all rights reserved ; alle rechte vorbehalten
noncommercial ; for non ?commercial use only / for non ?commercial use only ; non ?commercial use only ; not for commercial use
research-only ; for research purposes only / for academic use only research ; research use only ; non ?commercial research licen[cs]e
gpl-3-or-later ; (?:gnu )?(?:general public licen[cs]e|gpl) (?:as published by (?:the )?free software foundation )?(?:either )?v(?:er(?:sion)?)? ?3(?: 0)? (?:of (?:the )?licen[cs]e )?or (?:at your option )?(?:any )?later / gnu gpl v(?:er(?:sion)?)? ?3(?: 0)? or later ; gpl ?v?3(?: 0)? or (?:any )?later / gpl ?v?3(?: 0)? ?plus ; spdx licen[cs]e identifier gpl 3 0 or later
gpl-2-or-later ; (?:gnu )?(?:general public licen[cs]e|gpl) (?:as published by (?:the )?free software foundation )?(?:either )?v(?:er(?:sion)?)? ?2(?: 0)? (?:of (?:the )?licen[cs]e )?or (?:at your option )?(?:any )?later / gnu gpl v(?:er(?:sion)?)? ?2(?: 0)? or later ; gpl ?v?2(?: 0)? or (?:any )?later / gpl ?v?2(?: 0)? ?plus ; spdx licen[cs]e identifier gpl 2 0 or later
lgpl-3-or-later ; (?:gnu )?lesser general public licen[cs]e v(?:er(?:sion)?)? ?3(?: 0)? or (?:at your option )?(?:any )?later ; lgpl ?v?3(?: 0)? or (?:any )?later ; spdx licen[cs]e identifier lgpl 3 0 or later
lgpl-2.1-or-later ; (?:gnu )?lesser general public licen[cs]e (?:as published by (?:the )?free software foundation )?(?:either )?v(?:er(?:sion)?)? ?2 1 (?:of (?:the )?licen[cs]e )?or (?:at your option )?(?:any )?later ; lgpl ?v?2 1 or (?:any )?later ; spdx licen[cs]e identifier lgpl 2 1 or later
agpl-3-or-later ; (?:gnu )?affero general public licen[cs]e v(?:er(?:sion)?)? ?3(?: 0)? or (?:at your option )?(?:any )?later ; agpl ?v?3(?: 0)? or (?:any )?later ; spdx licen[cs]e identifier agpl 3 0 or later
gpl-3 ; under (?:the )?(?:terms of (?:the )?)?gpl ?v?3(?: 0)? ; gpl ?v?3(?: 0)? ; gpl 3 0 only
gpl-2 ; under (?:the )?(?:terms of (?:the )?)?gpl ?v?2(?: 0)? ; gpl ?v?2(?: 0)? ; gpl 2 0 only
lgpl-3 ; under (?:the )?(?:terms of (?:the )?)?lgpl ?v?3(?: 0)? ; lgpl ?v?3(?: 0)? ; lgpl 3 0 only
lgpl-2.1 ; under (?:the )?(?:terms of (?:the )?)?lgpl ?v?2 1 ; lgpl ?v?2 1 ; lgpl 2 1 only
agpl-3 ; under (?:the )?(?:terms of (?:the )?)?agpl ?v?3(?: 0)? ; agpl ?v?3(?: 0)? ; agpl 3 0 only
gpl-linking-exception ; as a special exception (?:the )?(?:copyright holders?|authors?) .{0,40}?give (?:you )?permission to link ; (?:gpl|gnu general public licen[cs]e) (?:v(?:er(?:sion)?)? ?\d )?with (?:the )?(?:classpath|linking|runtime library) exception ; gpl \d 0 with \w+ exception
apache-2 ; (?:released|available|distributed|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)? licen[cs]e(?: v(?:er(?:sion)?)?)? ?2(?: 0)? ; apache(?: software)? licen[cs]e(?: v(?:er(?:sion)?)?)? ?2(?: 0)? ; apache ?2 0 licen[cs]ed?
mit ; (?:released|available|distributed|provided|licen[cs]ed) (?:under|as) (?:the )?(?:terms of (?:the )?)?(?:mit|expat) licen[cs]e ; (?:mit|expat|mit style|mit like) licen[cs]ed? ; licen[cs]e mit
bsd-3-clause ; (?:released|available|distributed|licen[cs]ed) under (?:the |a )?(?:3 clause|three clause|new|modified|revised) bsd licen[cs]e ; (?:3 clause|three clause|new|modified|revised) bsd licen[cs]e ; bsd ?3 clause
bsd-2-clause ; (?:released|available|distributed|licen[cs]ed) under (?:the |a )?(?:2 clause|two clause|simplified) bsd licen[cs]e ; (?:2 clause|two clause|simplified) bsd licen[cs]e ; bsd ?2 clause
mpl-2 ; (?:released|available|distributed|licen[cs]ed) under (?:the )?(?:mpl|mozilla public licen[cs]e)(?: v(?:er(?:sion)?)?)? ?2(?: 0)? ; mpl(?: v(?:er(?:sion)?)?)? ?2(?: 0)? ; mpl 2 0 no copyleft exception
cc-by-sa ; (?:released|available|distributed|licen[cs]ed) under (?:the |a )?(?:creative commons|cc) (?:attribution|by) share ?alike ; cc by sa(?: [1-4] [05])?(?: international| unported)? ; by sa [1-4] [05]
cc-by-nc ; (?:released|available|distributed|licen[cs]ed) under (?:the |a )?(?:creative commons|cc) (?:attribution|by) non ?commercial ; cc by nc(?: [1-4] [05])?(?: international| unported)? ; by nc [1-4] [05]
cc-by ; (?:released|available|distributed|licen[cs]ed) under (?:the |a )?(?:creative commons|cc) (?:attribution|by)(?: [1-4] [05])? ; cc by(?: [1-4] [05])(?: international| unported)? ; by [1-4] [05] international
cc0 ; (?:released|available|distributed|dedicated) (?:under|with|to (?:the )?public domain (?:under|with)) (?:the )?(?:creative commons )?cc ?(?:0|zero) ; cc0(?: 1 0)? / cc zero(?: 1 0)? / creative commons zero(?: v(?:er(?:sion)?)?)?(?: 1 0)? ; cc0 1 0 universal
copyright-line ; copyright(?: c)?(?: by)? (?:19|20)\d\d(?: (?:19|20)\d\d){0,9} [^\x00-\x2F\x3A-\x60\x7B-\x7F]{2,40}(?: [^\x00-\x2F\x3A-\x60\x7B-\x7F]{1,40}){0,4}? all rights reserved ; copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)? ; copyright(?: c)? holders?
no-warranty ; (?:this|the) software is provided as is without warranty of any kind ; provided (?:on an )?as is (?:basis )?without (?:any )?(?:express or implied )?warrant(?:y|ies) ; without (?:any|even the implied) warranty
"""

HINTS = r"""
licen[cs]ed? under / spdx licen[cs]e identifier / licen[cs]e agreement / terms of (?:the |this )?licen[cs]e / (?:open|free) ?source licen[cs]e / (?:dual|multi) licen[cs]ed / licen[cs]e (?:file|text|terms|notice) / see (?:the )?licen[cs]e / permission is (?:hereby )?granted / may not be (?:used|copied|distributed|reproduced) (?:without|except)
"""

_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"0-9A-Za-z\x80-\xff"
_COMMON = ("licen", "software", "identifier", "under", "with", "the", "this", "for", "and", "terms", "public", "general")


def _compile(pattern: str) -> re.Pattern:
    """A pattern over words: a space stands for separators, ``  ?`` for some or none; ends are word boundaries."""
    spaced = pattern.replace(" ?", f"(?:{_SEP})?").replace(" ", _SEP)
    return re.compile(f"(?<![{_WORD}])(?:{spaced})(?![{_WORD}])".encode("latin-1"))


def _keyword(pattern: str) -> bytes:
    """The longest run of letters and digits that every match has, common words last."""
    last, plain = None, pattern
    while plain != last:  # groups from the innermost out, then classes, escapes and what may be missing
        last, plain = plain, re.sub(r"\((?:\?:)?[^()]*\)(?:[?*]|\{\d+(?:,\d*)?\}\??)?", " ", plain)
    plain = re.sub(r"(?:\[[^\]]*\]|\\x[0-9A-F]{2}|\\.|\.)(?:[?*+]|\{\d+(?:,\d*)?\})?\??", " ", plain)
    plain = re.sub(r"[a-z0-9][?*]", " ", plain)
    return max(re.findall("[a-z0-9]+", plain), key=lambda w: (w not in _COMMON and len(w) > 1, len(w) > 2, len(w))).encode()


def rules() -> list[tuple[str, int, bytes, re.Pattern]]:
    """All rules in the order of their priorities; of equal patterns the first counts."""
    out, known = [], set()
    for line in SIGNATURES.strip().splitlines():
        label, *kinds = line.split(" ; ")
        for priority, patterns in enumerate(kinds, 1):
            out += [(label, priority, p) for p in patterns.split(" / ")]
    out += [("unknown-license", 4, p) for p in HINTS.strip().split(" / ")]
    return [(label, n, _keyword(p), _compile(p)) for label, n, p in sorted(out, key=lambda r: r[1]) if p not in known and not known.add(p)]


def resolve(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str, int]]:
    """Detections (priority, start, end, label) -> (start, end, label, priority) of those that lie in no earlier one, by place.

    Earlier: lower priority, then longer, then first by place and label.  What lies in a dropped one lies in a kept one too, so that
    all earlier ones count: of those of lower priority that start no later, the largest end is looked up; of its own
    priority, a sweep by start, longest first, carries it.
    """
    kept, starts, ends = [], [], []
    groups: dict[int, list[tuple[int, int, int, str]]] = {}
    for x in found:
        groups.setdefault(x[0], []).append(x)
    for priority in sorted(groups):
        reach, own = -1, []
        for _, start, end, label in sorted(groups[priority], key=lambda x: (x[1], -x[2], x[3])):
            at = bisect_right(starts, start) - 1
            if end > reach and (at < 0 or ends[at] < end):
                kept.append((start, end, label, priority))
                own.append((start, end))
            reach = max(reach, end)
        merged = sorted([*zip(starts, ends), *own])
        starts = [s for s, _ in merged]
        ends = list(accumulate((e for _, e in merged), max))
    return sorted(kept)


class Scanner:
    def __init__(self):
        self.base = [(_compile(p), max(p.split(), key=len).encode(), label) for p, label in BASE.items()]
        self.by_keyword: dict[bytes, list[tuple[str, int, re.Pattern]]] = {}
        for label, priority, keyword, pattern in rules():
            self.by_keyword.setdefault(keyword, []).append((label, priority, pattern))

    def scan(self, text: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int]]]:
        """Of a lower-cased text: base places (start, end, label), resolved detections (start, end, label, priority), in bytes."""
        base = [(m.start(), m.end(), label) for pattern, word, label in self.base if word in text for m in pattern.finditer(text)]
        found = []
        for keyword, own in self.by_keyword.items():
            if keyword in text:
                found += [(priority, m.start(), m.end(), label) for label, priority, pattern in own for m in pattern.finditer(text)]
        return sorted(base), resolve(found)


_SCANNERS: list[Scanner] = []
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])))]
    + [("detections", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())])))]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _SCANNERS:
        _SCANNERS.append(Scanner())
    scanner = _SCANNERS[0]
    for batch in batches:
        n, base, kept = [], [], []
        for _, data, offsets in chunks(batch.column(1)):
            starts, _, _ = spans(data, offsets, ALNUM)
            first = np.searchsorted(starts, offsets)
            low = data.tobytes().lower()
            for i in range(len(offsets) - 1):
                b, k = scanner.scan(low[offsets[i] : offsets[i + 1]])
                at = lambda place: int(np.searchsorted(starts, offsets[i] + place) - first[i])  # noqa: B023, E731
                n.append(int(first[i + 1] - first[i]))
                base.append([{"word": at(s), "label": label} for s, _, label in b])
                kept.append([{"start": at(s), "end": at(e), "label": label, "priority": p} for s, e, label, p in k])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, f.type) for v, f in zip((n, base, kept), list(_SCHEMA)[1:]))], schema=_SCHEMA)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, base: array of (word, label), detections: array of (start, end, label, priority).

    Places are in words, from 0; ``end`` is the word after the last.  Words: letters, digits and all
    beyond ASCII, A to Z folded.  Null texts have no words; rows with null or equal ids each give a row; no rows give
    none; other columns are ignored.  Narrow: no shuffle, one text at a time.
    """
    small_batches(docs.sparkSession)
    from pyspark.sql import functions as F

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _scan, "doc_id long, n_words long, base array<struct<word: long, label: string>>, detections array<struct<start: long, end: long, label: string, priority: int>>"
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and labels of every document; score: how sure the surest detection is (notice 1, name 0.9, identifier 0.8, hint 0.5)."""
    from pyspark.sql import functions as F

    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sure = F.element_at(F.array(F.lit(1.0), F.lit(0.9), F.lit(0.8), F.lit(0.5)), F.array_min(F.transform("detections", lambda d: d["priority"])))
    names = F.transform("base", lambda b: b["label"])
    more = F.concat(names, F.transform("detections", lambda d: d["label"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["word"])).alias("first_word"), F.array_max(F.transform("base", lambda b: b["word"])).alias("last_word"),
        joined(names).alias("base_labels"), joined(more).alias("labels"),
        F.coalesce(F.when(F.size("base") > 0, F.lit(1.0)), F.when(F.size("detections") > 0, sure), F.lit(0.0)).alias("score"),
    )

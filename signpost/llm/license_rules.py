"""Signature rules of licenses, over a text's words in lower case with one space between two of them.

A line is ``level label pattern``. The pattern's first word is plain: the keyword at which the rule is
tried. Levels rank rules, the lower the stronger: 1 identifiers in a stated form, 2 sentences of a
license's own text, 3 notices and names with a version, 4 bare names, 5 traces that name no license.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: How sure a detection of each level is.
CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.7, 5: 0.2}
#: The longest stretch of words that a rule can match.
SPAN = 28
#: A text that holds none of these, ASCII letters in lower case, meets no rule.
STEMS = ("licen", "copyright", "copyleft", "spdx", "permission", "redistribut", "warrant", "domain", "reserved",
         "gpl", "cc by", "cc-by", "cc0", "commons", "wtfpl", "proprietary", "confidential")
#: Rules whose places are counted in themselves, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


class Rule(NamedTuple):
    id: int
    level: int
    label: str
    keyword: str
    pattern: str
    base: bool


_LINES = r"""
1 mit spdx license identifier mit
1 mit-0 spdx license identifier mit 0
1 isc spdx license identifier isc
1 0bsd spdx license identifier 0bsd
1 bsd-2-clause spdx license identifier bsd 2 clause
1 bsd-3-clause spdx license identifier bsd 3 clause
1 bsd-4-clause spdx license identifier bsd 4 clause
1 apache-1.1 spdx license identifier apache 1 1
1 apache-2.0 spdx license identifier apache 2 0
1 apache-2.0-with-llvm-exception spdx license identifier apache 2 0 with llvm exception
1 gpl-1.0 spdx license identifier gpl 1 0( only| or later)?
1 gpl-2.0-only spdx license identifier gpl 2 0( only)?
1 gpl-2.0-or-later spdx license identifier gpl 2 0 or later
1 gpl-2.0-with-classpath-exception spdx license identifier gpl 2 0( only| or later)? with classpath exception 2 0
1 gpl-2.0-with-linux-syscall-note spdx license identifier gpl 2 0( only| or later)? with linux syscall note
1 gpl-3.0-only spdx license identifier gpl 3 0( only)?
1 gpl-3.0-or-later spdx license identifier gpl 3 0 or later
1 lgpl-2.0 spdx license identifier lgpl 2 0( only| or later)?
1 lgpl-2.1-only spdx license identifier lgpl 2 1( only)?
1 lgpl-2.1-or-later spdx license identifier lgpl 2 1 or later
1 lgpl-3.0-only spdx license identifier lgpl 3 0( only)?
1 lgpl-3.0-or-later spdx license identifier lgpl 3 0 or later
1 agpl-3.0-only spdx license identifier agpl 3 0( only)?
1 agpl-3.0-or-later spdx license identifier agpl 3 0 or later
1 gfdl-1.3 spdx license identifier gfdl 1 3( only| or later)?
1 mpl-1.1 spdx license identifier mpl 1 1
1 mpl-2.0 spdx license identifier mpl 2 0
1 epl-1.0 spdx license identifier epl 1 0
1 epl-2.0 spdx license identifier epl 2 0
1 eupl-1.2 spdx license identifier eupl 1 2
1 cddl-1.0 spdx license identifier cddl 1 0
1 cddl-1.1 spdx license identifier cddl 1 1
1 artistic-2.0 spdx license identifier artistic 2 0
1 bsl-1.0 spdx license identifier bsl 1 0
1 busl-1.1 spdx license identifier busl 1 1
1 zlib spdx license identifier zlib
1 libpng-2.0 spdx license identifier libpng 2 0
1 unlicense spdx license identifier unlicense
1 wtfpl spdx license identifier wtfpl
1 cc0-1.0 spdx license identifier cc0 1 0
1 cc-by-4.0 spdx license identifier cc by 4 0
1 cc-by-sa-4.0 spdx license identifier cc by sa 4 0
1 cc-by-nc-4.0 spdx license identifier cc by nc 4 0
1 cc-by-nd-4.0 spdx license identifier cc by nd 4 0
1 ofl-1.1 spdx license identifier ofl 1 1
1 psf-2.0 spdx license identifier (psf|python) 2 0
1 postgresql spdx license identifier postgresql
1 ncsa spdx license identifier ncsa
1 sspl-1.0 spdx license identifier sspl 1 0
1 elastic-2.0 spdx license identifier elastic 2 0
1 other-spdx spdx license identifier [^ ]+
2 mit permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
2 mit permission is hereby granted free of charge to any person obtaining a copy
2 mit above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
2 x11 except as contained in this notice the names? of( the)? [^ ]+( [^ ]+){0,5} shall not be used in advertising
2 isc permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted
2 0bsd permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is
2 postgresql permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
2 hpnd permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
2 bsd redistribution and use in source and binary forms with or without modification are permitted
2 bsd-2-clause redistributions of source code must retain the above copyright notice
2 bsd-2-clause redistributions in binary form must reproduce the above copyright notice
2 bsd-3-clause neither the name of( the)? [^ ]+( [^ ]+){0,6} nor the names of( its)? contributors
2 bsd-4-clause advertising materials mentioning features or use of this software must display the following acknowledge?ment
2 apache-2.0 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
2 apache-2.0 may not use this file except in compliance with the license
2 apache-2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
2 apache-1.1 product includes software developed by the apache software foundation
2 gpl program is free software you can redistribute it and or modify it under the terms of the gnu general public license
2 gpl program is distributed in the hope that it will be useful but without any warranty
2 gpl should have received a copy of the gnu general public license along with this (program|software|file|package)
2 gpl-2.0-or-later either version 2 of the license or( at your option)? any later version
2 gpl-3.0-or-later either version 3 of the license or( at your option)? any later version
2 lgpl library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license
2 lgpl-2.1-or-later either version 2 1 of the license or( at your option)? any later version
2 agpl should have received a copy of the gnu affero general public license along with this (program|software|file)
2 agpl terms of the gnu affero general public license as published by the free software foundation
2 gpl gnu general public license as published by the free software foundation
2 lgpl gnu (lesser|library) general public license as published by the free software foundation
2 gfdl permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
2 mpl-2.0 source code form is subject to the terms of the mozilla public license v 2 0
2 mpl-1.1 contents of this file are subject to the mozilla public license version 1 1
2 epl-1.0 accompanying materials are made available under the terms of the eclipse public license v1 0
2 epl-2.0 accompanying materials are made available under the terms of the eclipse public license( v| version)? 2 0
2 cddl contents of this file are subject to the terms of the common development and distribution license
2 bsl-1.0 distributed under the boost software license version 1 0
2 bsl-1.0 boost software license version 1 0 august 17th 2003
2 zlib software is provided as is without any express or implied warranty in no event will the authors be held liable
2 zlib altered source versions must be plainly marked as such
2 unlicense free and unencumbered software released into the public domain
2 unlicense anyone is free to copy modify publish use compile sell or distribute this software
2 wtfpl everyone is permitted to copy and distribute verbatim or modified copies of this license document
2 wtfpl what the fuck you want to public license
2 beerware long as you retain this notice you can do whatever you want with this stuff
2 json software shall be used for good not evil
2 ofl font software is licensed under the sil open font license
2 ncsa permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software
2 psf python software foundation license version 2
2 cc0-1.0 extent possible under law [^ ]+( [^ ]+){0,6} (has|have) waived all copyright
2 openssl product includes software developed by the openssl project
2 ssleay product includes cryptographic software written by eric young
2 php product includes php software
2 vim restrictions on distributing unmodified copies of vim
2 icu unicode inc license agreement data files and software
2 commons-clause software is provided to you by the licensor under the license as defined below subject to the following condition
2 elastic-2.0 may not provide the software to third parties as a hosted or managed service
2 busl-1.1 licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
3 mit available under( the)?( terms of)?( the)? mit( x11| expat)? licen[sc]e
3 mit released under( the)?( terms of)?( the)? mit( x11| expat)? licen[sc]e
3 mit licensed under( the)?( terms of)?( the)? mit( x11| expat)? licen[sc]e
3 mit distributed under( the)?( terms of)?( the)? mit( x11| expat)? licen[sc]e
3 mit license mit
3 mit licence mit
3 mit mit licensed
3 mit-0 mit no attribution( licen[sc]e)?
3 isc licensed under( the)?( terms of)?( the)? isc licen[sc]e
3 isc released under( the)?( terms of)?( the)? isc licen[sc]e
3 bsd licensed under( the)?( terms of)?( the| a)? bsd( style)? licen[sc]e
3 bsd released under( the)?( terms of)?( the| a)? bsd( style)? licen[sc]e
3 bsd-2-clause bsd 2 clause( licen[sc]e)?
3 bsd-2-clause simplified bsd licen[sc]e
3 bsd-2-clause freebsd licen[sc]e
3 bsd-3-clause bsd 3 clause( licen[sc]e)?
3 bsd-3-clause new bsd licen[sc]e
3 bsd-3-clause modified bsd licen[sc]e
3 bsd-3-clause revised bsd licen[sc]e
3 bsd-4-clause bsd 4 clause( licen[sc]e)?
3 bsd-4-clause original bsd licen[sc]e
3 0bsd zero clause bsd( licen[sc]e)?
3 apache-2.0 licensed under( the)?( terms of)?( the)? apache( software)? licen[sc]e( version| v)? 2( 0)?
3 apache-2.0 released under( the)?( terms of)?( the)? apache( software)? licen[sc]e( version| v)? 2( 0)?
3 apache-2.0 apache( software)? licen[sc]e( version| v)? 2( 0)?
3 apache-2.0 apache( software)? licen[sc]e v2( 0)?
3 apache-2.0 apache 2( 0)?( licen[sc]e)?
3 apache-2.0 apache v2( 0)?( licen[sc]e)?
3 apache-2.0 asl 2 0
3 apache-1.1 apache( software)? licen[sc]e( version| v)? 1 1
3 apache-1.0 apache( software)? licen[sc]e( version| v)? 1 0
3 gpl-1.0 gnu general public licen[sc]e( version| v)? 1( 0)?
3 gpl-2.0 gnu general public licen[sc]e( gpl)?( version| v)? 2( 0)?
3 gpl-2.0 gnu general public licen[sc]e( gpl)? v2( 0)?
3 gpl-3.0 gnu general public licen[sc]e( gpl)?( version| v)? 3( 0)?
3 gpl-3.0 gnu general public licen[sc]e( gpl)? v3( 0)?
3 gpl-2.0 licensed under( the)?( terms of)?( the)? gnu general public licen[sc]e( version| v)? 2( 0)?
3 gpl-3.0 licensed under( the)?( terms of)?( the)? gnu general public licen[sc]e( version| v)? 3( 0)?
3 gpl-2.0 gnu gpl( version| v)? 2( 0)?
3 gpl-2.0 gnu gpl v2( 0)?
3 gpl-3.0 gnu gpl( version| v)? 3( 0)?
3 gpl-3.0 gnu gpl v3( 0)?
3 gpl-2.0 gplv2
3 gpl-2.0-or-later gplv2 or later
3 gpl-3.0 gplv3
3 gpl-3.0-or-later gplv3 or later
3 gpl-2.0 gpl( version| v)? 2( 0)?
3 gpl-2.0 gpl v2( 0)?
3 gpl-3.0 gpl( version| v)? 3( 0)?
3 gpl-3.0 gpl v3( 0)?
3 lgpl-2.0 gnu library general public licen[sc]e( version| v)? 2( 0)?
3 lgpl-2.1 gnu lesser general public licen[sc]e( version| v)? 2 1
3 lgpl-2.1 gnu lesser general public licen[sc]e v2 1
3 lgpl-3.0 gnu lesser general public licen[sc]e( version| v)? 3( 0)?
3 lgpl-3.0 gnu lesser general public licen[sc]e v3( 0)?
3 lgpl-2.1 lgplv2 1
3 lgpl-3.0 lgplv3
3 lgpl-2.1 lgpl( version| v)? 2 1
3 lgpl-3.0 lgpl( version| v)? 3( 0)?
3 agpl-3.0 gnu affero general public licen[sc]e( version| v)? 3( 0)?
3 agpl-3.0 gnu affero general public licen[sc]e v3( 0)?
3 agpl-3.0 affero general public licen[sc]e( version| v)? 3( 0)?
3 agpl-3.0 agplv3
3 agpl-3.0 agpl( version| v)? 3( 0)?
3 gfdl-1.2 gnu free documentation licen[sc]e( version| v)? 1 2
3 gfdl-1.3 gnu free documentation licen[sc]e( version| v)? 1 3
3 mpl-1.0 mozilla public licen[sc]e( version| v)? 1 0
3 mpl-1.1 mozilla public licen[sc]e( version| v)? 1 1
3 mpl-2.0 mozilla public licen[sc]e( version| v)? 2( 0)?
3 mpl-2.0 mpl( version| v)? 2 0
3 mpl-2.0 mplv2( 0)?
3 epl-1.0 eclipse public licen[sc]e( version| v)? 1( 0)?
3 epl-2.0 eclipse public licen[sc]e( version| v)? 2( 0)?
3 eupl-1.1 european union public licen[sc]e( version| v)? 1 1
3 eupl-1.2 european union public licen[sc]e( version| v)? 1 2
3 cddl-1.0 common development and distribution licen[sc]e( cddl)?( version| v)? 1 0
3 cddl-1.1 common development and distribution licen[sc]e( cddl)?( version| v)? 1 1
3 cpl-1.0 common public licen[sc]e( version| v)? 1 0
3 artistic-1.0 artistic licen[sc]e( version| v)? 1( 0)?
3 artistic-2.0 artistic licen[sc]e( version| v)? 2( 0)?
3 perl terms as perl( itself| 5)?
3 bsl-1.0 boost software licen[sc]e( version| v)? 1 0
3 busl-1.1 business source licen[sc]e( version| v)? 1 1
3 lppl-1.3 latex project public licen[sc]e( version| v)? 1 3c?
3 ofl-1.1 sil open font licen[sc]e( version| v)? 1 1
3 cecill-2.0 cecill( free software)? licen[sc]e( agreement)?( version| v)? 2( 0| 1)?
3 osl-3.0 open software licen[sc]e( version| v)? 3 0
3 afl-3.0 academic free licen[sc]e( version| v)? 3 0
3 ms-pl microsoft public licen[sc]e
3 ms-rl microsoft reciprocal licen[sc]e
3 sspl-1.0 server side public licen[sc]e( version| v)? 1
3 elastic-2.0 elastic licen[sc]e( version| v)? 2( 0)?
3 polyform-noncommercial polyform noncommercial licen[sc]e( version| v)?( 1 0 0)?
3 odbl-1.0 open database licen[sc]e( odbl)?( version| v)?( 1 0)?
3 odc-by-1.0 open data commons attribution licen[sc]e
3 pddl-1.0 open data commons public domain dedication and licen[sc]e
3 cc0-1.0 cc0 1 0( universal)?
3 cc0-1.0 creative commons (zero|cc0)( 1 0)?( universal)?
3 cc-by-1.0 cc by 1 0
3 cc-by-2.0 cc by 2 0
3 cc-by-2.5 cc by 2 5
3 cc-by-3.0 cc by 3 0
3 cc-by-4.0 cc by 4 0
3 cc-by-sa-1.0 cc by sa 1 0
3 cc-by-sa-2.0 cc by sa 2 0
3 cc-by-sa-2.5 cc by sa 2 5
3 cc-by-sa-3.0 cc by sa 3 0
3 cc-by-sa-4.0 cc by sa 4 0
3 cc-by-nc-2.0 cc by nc 2 0
3 cc-by-nc-3.0 cc by nc 3 0
3 cc-by-nc-4.0 cc by nc 4 0
3 cc-by-nd-3.0 cc by nd 3 0
3 cc-by-nd-4.0 cc by nd 4 0
3 cc-by-nc-sa-3.0 cc by nc sa 3 0
3 cc-by-nc-sa-4.0 cc by nc sa 4 0
3 cc-by-nc-nd-3.0 cc by nc nd 3 0
3 cc-by-nc-nd-4.0 cc by nc nd 4 0
3 cc-by-3.0 creative commons attribution 3 0( international| unported)?( licen[sc]e)?
3 cc-by-4.0 creative commons attribution 4 0( international)?( public)?( licen[sc]e)?
3 cc-by-sa-3.0 creative commons attribution share ?alike 3 0( international| unported)?( licen[sc]e)?
3 cc-by-sa-4.0 creative commons attribution share ?alike 4 0( international)?( public)?( licen[sc]e)?
3 cc-by-nc-4.0 creative commons attribution non ?commercial 4 0( international)?( public)?( licen[sc]e)?
3 cc-by-nd-4.0 creative commons attribution no ?deriv(ative)?s 4 0( international)?( public)?( licen[sc]e)?
3 cc-by-nc-sa-4.0 creative commons attribution non ?commercial share ?alike 4 0( international)?( public)?( licen[sc]e)?
3 cc-by-nc-nd-4.0 creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?( public)?( licen[sc]e)?
3 ogl-uk-3.0 open government licen[sc]e( version| v)? 3( 0)?
3 etalab-2.0 licence ouverte( version| v)? 2 0
3 public-domain released (in|into) the public domain
3 public-domain placed (in|into) the public domain
3 public-domain dedicated to the public domain
4 mit mit license
4 mit mit licence
4 mit expat licen[sc]e
4 x11 x11 licen[sc]e
4 isc isc licen[sc]e
4 bsd bsd( style)? licen[sc]e
4 apache apache license
4 apache apache (software license|licence)
4 gpl general public license
4 gpl gnu (general public licen[sc]e|gpl)
4 gpl gpl( licensed| licen[sc]e)
4 lgpl gnu (lesser|library) general public licen[sc]e
4 lgpl lgpl
4 agpl gnu affero general public licen[sc]e
4 agpl affero general public licen[sc]e
4 agpl agpl
4 gfdl gnu free documentation licen[sc]e
4 mpl mozilla public licen[sc]e
4 npl netscape public licen[sc]e
4 epl eclipse public licen[sc]e
4 eupl european union public licen[sc]e
4 cddl common development and distribution licen[sc]e
4 cpl common public licen[sc]e
4 ipl ibm public licen[sc]e
4 artistic artistic licen[sc]e
4 bsl-1.0 boost software licen[sc]e
4 busl business source licen[sc]e
4 zlib zlib( libpng)? licen[sc]e
4 libpng libpng licen[sc]e
4 unlicense unlicense
4 wtfpl wtfpl
4 beerware beerware( licen[sc]e)?
4 cc0 cc0
4 cc-by cc by
4 cc-by-sa cc by sa
4 cc-by-nc cc by nc
4 cc-by-nd cc by nd
4 cc-by-nc-sa cc by nc sa
4 cc-by-nc-nd cc by nc nd
4 cc creative commons( attribution)?( licen[sc]e)?
4 ofl sil open font licen[sc]e
4 ofl open font licen[sc]e
4 odbl open database licen[sc]e
4 ogl-uk open government licen[sc]e
4 osl open software licen[sc]e
4 afl academic free licen[sc]e
4 lppl latex project public licen[sc]e
4 psf python software foundation licen[sc]e
4 psf psf licen[sc]e
4 php php licen[sc]e
4 ruby ruby licen[sc]e
4 openssl openssl licen[sc]e
4 postgresql postgresql licen[sc]e
4 ncsa ncsa( open source)? licen[sc]e
4 vim vim licen[sc]e
4 w3c w3c( software)?( notice and)? licen[sc]e
4 zpl zope public licen[sc]e
4 qpl q public licen[sc]e
4 sleepycat sleepycat licen[sc]e
4 sspl server side public licen[sc]e
4 elastic elastic licen[sc]e
4 commons-clause commons clause
4 cecill cecill
4 ms-pl ms pl
4 json json licen[sc]e
4 curl curl licen[sc]e
4 icu icu licen[sc]e
4 public-domain public domain
4 dual-license dual licen[sc]ed
4 proprietary proprietary( and)? (confidential|licen[sc]e|software)
4 proprietary end user licen[sc]e agreement
4 proprietary confidential and proprietary
5 copyright copyright( c)? (19|20)[0-9][0-9]
5 copyright rights reserved
5 copyright copyright notice
5 copyleft copyleft
5 license-mention license( agreement| terms| file| text)
5 license-mention licenced under
5 license-mention licensed under
5 warranty-mention without (any )?warrant(y|ies)
5 warranty-mention warranty disclaimer
"""


def rules() -> list[Rule]:
    """All rules, the stronger first."""
    found = []
    for line in filter(None, _LINES.splitlines()):
        level, label, pattern = line.split(" ", 2)
        keyword = re.match(r"[a-z0-9]+(?=$| |\( )", pattern)[0]
        found.append(Rule(len(found), int(level), label, keyword, pattern, pattern in BASE))
    return found

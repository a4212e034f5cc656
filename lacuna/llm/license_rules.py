"""Signature rules for licenses, written by hand: level | label | keywords | pattern.

Patterns are read against a text's words, joined by single spaces, letters A-Z in either case; a match begins and
ends at words. Marks between words (2.0, GPL-3) are spaces there. One of a rule's keywords must be a word of the
text for the rule to be tried at all. Levels: 1 a sentence of the license itself, 2 a machine-readable tag, 3 a
named version, 4 a name, 5 a hint that names no license.
"""

from __future__ import annotations

from typing import NamedTuple

#: What a level's detections are worth.
CONFIDENCE = {1: 0.99, 2: 0.97, 3: 0.9, 4: 0.75, 5: 0.3}

#: Base phrases, by label: always reported.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

TEXT = r"""
1 | mit | associated | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 | mit | sublicense | to use copy modify merge publish distribute sublicense and or sell copies of the software
1 | mit | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1 | mit-0 | furnished | and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
1 | mit-advertising | advertising | shall be included in all copies or substantial portions of the software and all advertising materials
1 | isc | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
1 | 0bsd | hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
1 | hpnd | hereby | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted
1 | ntp | hereby | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
1 | bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
1 | bsd | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
1 | bsd | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
1 | bsd-3-clause | endorse | neither the names? of (?:\S+ ){1,12}may be used to endorse or promote products derived from this software
1 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
1 | bsd-3-clause-clear | patent | no express or implied licenses to any party s patent rights are granted by this license
1 | bsd-2-clause-patent | contributor | each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide
1 | apache-2.0 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
1 | apache-2.0 | contributor | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
1 | apache-1.1 | apache | products derived from this software may not be called apache nor may apache appear in their name
1 | gpl | gnu | (?:is|are) free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
1 | gpl-2.0-or-later | gnu | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
1 | gpl-3.0-or-later | gnu | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 | gpl-2.0-only | gnu | gnu general public license version 2 as published by the free software foundation
1 | gpl-3.0-only | gnu | gnu general public license version 3 as published by the free software foundation
1 | gpl | freedom | the licenses for most software are designed to take away your freedom to share and change it
1 | gpl | copyleft | the gnu general public license is a free copyleft license for software and other kinds of works
1 | lgpl-2.1-or-later | lesser | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
1 | lgpl-3.0-or-later | lesser | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 | lgpl-2.0-or-later | library | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
1 | agpl-3.0-or-later | affero | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 | agpl-3.0 | affero | the gnu affero general public license is a free copyleft license for software and other kinds of works
1 | gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
1 | gfdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
1 | mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
1 | mpl-2.0 | incompatible | this source code form is incompatible with secondary licenses as defined by the mozilla public license
1 | mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
1 | epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0
1 | epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1 0
1 | cddl-1.0 | cddl/development | the contents of this file are subject to the terms of the common development and distribution license
1 | cpl-1.0 | accompanying | the accompanying program is provided under the terms of this common public license
1 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
1 | cc0-1.0 | waived | to the extent possible under law (?:\S+ ){1,12}waived all copyright and related or neighboring rights
1 | cc0-1.0 | affirmer | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright
1 | wtfpl | want | you just do what the fuck you want to
1 | zlib | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
1 | zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
1 | bsl-1.0 | boost | distributed under the boost software license version 1 0
1 | bsl-1.0 | accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
1 | artistic-2.0 | restriction | you are permitted to use the standard version and create and use modified versions for any purpose without restriction
1 | artistic-1.0 | package | you may make and give away verbatim copies of the source form of the standard version of this package without restriction
1 | afl-3.0 | academic | licensed under the academic free license version 3 0
1 | osl-3.0 | open | licensed under the open software license version 3 0
1 | ofl-1.1 | font | this font software is licensed under the sil open font license version 1 1
1 | ofl-1.1 | font | neither the font software nor any of its individual components in original or modified versions may be sold by itself
1 | ms-pl | governs | this license governs use of the accompanying software if you use the software you accept this license
1 | python-2.0 | psf | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce
1 | openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
1 | ssleay | cryptographic | this product includes cryptographic software written by eric young
1 | curl | hereby | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
1 | x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
1 | ncsa | endorse | neither the names of (?:\S+ ){1,14}nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
1 | postgresql | agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
1 | unicode | unicode | to any person obtaining a copy of the unicode data files and any associated documentation
1 | w3c | licensee | by obtaining (?:using )?and or copying this work you the licensee agree that you have read understood and will comply
1 | ftl | freetype | portions of this software are copyright (?:\S+ ){1,4}the freetype project
1 | libpng | png | the png reference library is supplied as is
1 | ijg | jpeg | this software is based in part on the work of the independent jpeg group
1 | beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
1 | blessing | forgiveness | may you do good and not evil may you find forgiveness for yourself and forgive others
1 | json | evil | the software shall be used for good not evil
1 | busl-1.1 | licensor | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
1 | sspl-1.0 | service | if you make the functionality of the program or a modified version available to third parties as a service
1 | elastic-2.0 | managed | you may not provide the software to third parties as a hosted or managed service
1 | commons-clause | sell | the license does not grant to you the right to sell the software
1 | polyform | licensor | licensor grants you a copyright license for the software to do everything you might do with the software
1 | cc-by | attribution | this work is licensed under (?:a |the )?creative commons attribution (?:\d \d )?(?:international |unported |generic )?licen[sc]e
1 | cc-by-sa | sharealike/alike | this work is licensed under (?:a |the )?creative commons attribution share ?alike (?:\d \d )?(?:international |unported |generic )?licen[sc]e
1 | cc-by-nc | noncommercial/non | this work is licensed under (?:a |the )?creative commons attribution non ?commercial (?:\d \d )?(?:international |unported |generic )?licen[sc]e
1 | cc-by-nc-sa | noncommercial/non | this work is licensed under (?:a |the )?creative commons attribution non ?commercial share ?alike (?:\d \d )?(?:international |unported |generic )?licen[sc]e
1 | cc-by-nd | noderivatives/no/noderivs | this work is licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s (?:\d \d )?(?:international |unported |generic )?licen[sc]e
1 | proprietary | unauthorized | unauthorized (?:copying|use|reproduction) of this file (?:\S+ ){0,6}is strictly prohibited
1 | proprietary | proprietary | this software is (?:the )?(?:confidential and )?proprietary (?:and confidential )?(?:information )?(?:of|to)
2 | mit | spdx | spdx license identifier mit
2 | mit-0 | spdx | spdx license identifier mit 0
2 | isc | spdx | spdx license identifier isc
2 | 0bsd | spdx | spdx license identifier 0bsd
2 | bsd-2-clause | spdx | spdx license identifier bsd 2 clause
2 | bsd-3-clause | spdx | spdx license identifier bsd 3 clause
2 | bsd-4-clause | spdx | spdx license identifier bsd 4 clause
2 | apache-1.1 | spdx | spdx license identifier apache 1 1
2 | apache-2.0 | spdx | spdx license identifier apache 2 0
2 | gpl-1.0 | spdx | spdx license identifier gpl 1 0(?: only| or later)?
2 | gpl-2.0 | spdx | spdx license identifier gpl 2 0
2 | gpl-2.0-only | spdx | spdx license identifier gpl 2 0 only
2 | gpl-2.0-or-later | spdx | spdx license identifier gpl 2 0 or later
2 | gpl-3.0 | spdx | spdx license identifier gpl 3 0
2 | gpl-3.0-only | spdx | spdx license identifier gpl 3 0 only
2 | gpl-3.0-or-later | spdx | spdx license identifier gpl 3 0 or later
2 | lgpl-2.0 | spdx | spdx license identifier lgpl 2 0(?: only| or later)?
2 | lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
2 | lgpl-3.0 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
2 | agpl-3.0 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
2 | mpl-1.1 | spdx | spdx license identifier mpl 1 1
2 | mpl-2.0 | spdx | spdx license identifier mpl 2 0
2 | epl-1.0 | spdx | spdx license identifier epl 1 0
2 | epl-2.0 | spdx | spdx license identifier epl 2 0
2 | eupl-1.2 | spdx | spdx license identifier eupl 1 2
2 | cddl-1.0 | spdx | spdx license identifier cddl 1 0
2 | unlicense | spdx | spdx license identifier unlicense
2 | cc0-1.0 | spdx | spdx license identifier cc0 1 0
2 | cc-by-4.0 | spdx | spdx license identifier cc by 4 0
2 | cc-by-sa-4.0 | spdx | spdx license identifier cc by sa 4 0
2 | wtfpl | spdx | spdx license identifier wtfpl
2 | zlib | spdx | spdx license identifier zlib
2 | bsl-1.0 | spdx | spdx license identifier bsl 1 0
2 | artistic-2.0 | spdx | spdx license identifier artistic 2 0
2 | ofl-1.1 | spdx | spdx license identifier ofl 1 1
2 | postgresql | spdx | spdx license identifier postgresql
2 | ncsa | spdx | spdx license identifier ncsa
2 | busl-1.1 | spdx | spdx license identifier busl 1 1
2 | sspl-1.0 | spdx | spdx license identifier sspl 1 0
2 | mit | osi | license osi approved mit license
2 | bsd | osi | license osi approved bsd license
2 | apache | osi | license osi approved apache software license
2 | isc | osi | license osi approved isc license(?: iscl)?
2 | gpl-2.0 | osi | license osi approved gnu general public license v2(?: gplv2)?
2 | gpl-3.0 | osi | license osi approved gnu general public license v3(?: gplv3)?
2 | lgpl-3.0 | osi | license osi approved gnu lesser general public license v3(?: lgplv3)?
2 | mpl-2.0 | osi | license osi approved mozilla public license 2 0(?: mpl 2 0)?
2 | mit | opensource | opensource org licenses mit(?: license(?: php)?)?
2 | isc | opensource | opensource org licenses isc(?: license(?: txt)?)?
2 | bsd-2-clause | opensource | opensource org licenses bsd 2 clause
2 | bsd-3-clause | opensource | opensource org licenses bsd 3 clause
2 | apache-2.0 | apache | apache org licenses license 2 0(?: txt| html)?
2 | gpl | gnu | gnu org licenses gpl(?: html| txt)?
2 | gpl-2.0 | gnu | gnu org licenses (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?
2 | gpl-3.0 | gnu | gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
2 | lgpl | gnu | gnu org (?:licenses|copyleft) (?:old licenses )?lgpl(?: \d \d)?(?: html| txt)?
2 | agpl-3.0 | gnu | gnu org licenses agpl(?: 3 0)?(?: html| txt)?
2 | gfdl | gnu | gnu org (?:licenses|copyleft) fdl(?: \d \d)?(?: html| txt)?
2 | mpl-2.0 | mozilla | mozilla org mpl 2 0
2 | mpl-1.1 | mozilla | mozilla org mpl mpl 1 1(?: html)?
2 | epl-2.0 | eclipse | eclipse org legal epl (?:v20|2 0)(?: html)?
2 | epl-1.0 | eclipse | eclipse org legal epl v10(?: html)?
2 | cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
2 | public-domain | creativecommons | creativecommons org publicdomain mark 1 0
2 | cc-by | creativecommons | creativecommons org licenses by \d \d
2 | cc-by-sa | creativecommons | creativecommons org licenses by sa \d \d
2 | cc-by-nc | creativecommons | creativecommons org licenses by nc \d \d
2 | cc-by-nd | creativecommons | creativecommons org licenses by nd \d \d
2 | cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa \d \d
2 | cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd \d \d
2 | unlicense | unlicense | unlicense org
2 | bsl-1.0 | boost | boost org license 1 0(?: txt)?
2 | ofl-1.1 | sil | scripts sil org ofl
2 | wtfpl | wtfpl | wtfpl net
3 | apache-2.0 | apache | (?:the )?apache (?:software )?license (?:v|version )?2(?: 0)?
3 | apache-2.0 | apache | apache 2(?: 0)? licen[sc]ed?
3 | apache-2.0 | alv2 | alv2
3 | apache-1.1 | apache | apache (?:software )?license (?:version )?1 1
3 | apache-1.0 | apache | apache (?:software )?license (?:version )?1 0
3 | gpl-1.0 | general | (?:gnu )?general public license (?:version |v ?)1(?: 0)?
3 | gpl-2.0 | general | (?:gnu )?general public license (?:gpl )?(?:version |v ?)2(?: 0)?
3 | gpl-3.0 | general | (?:gnu )?general public license (?:gpl )?(?:version |v ?)3(?: 0)?
3 | gpl-2.0-or-later | general | (?:gnu )?general public license (?:gpl )?(?:version |v ?)2(?: 0)? or (?:at your option any )?later
3 | gpl-3.0-or-later | general | (?:gnu )?general public license (?:gpl )?(?:version |v ?)3(?: 0)? or (?:at your option any )?later
3 | gpl-2.0 | gplv2 | gplv2
3 | gpl-2.0-or-later | gplv2 | gplv2 or later
3 | gpl-3.0 | gplv3 | gplv3
3 | gpl-3.0-or-later | gplv3 | gplv3 or later
3 | gpl-2.0 | gpl | gpl (?:version |v ?)?2(?: 0)?
3 | gpl-3.0 | gpl | gpl (?:version |v ?)?3(?: 0)?
3 | gpl-2.0-or-later | gpl | gpl (?:version |v ?)?2(?: 0)? or (?:any )?later
3 | gpl-3.0-or-later | gpl | gpl (?:version |v ?)?3(?: 0)? or (?:any )?later
3 | lgpl-2.0 | library | (?:gnu )?library general public license (?:version |v ?)2(?: 0)?
3 | lgpl-2.1 | lesser | (?:gnu )?lesser general public license (?:lgpl )?(?:version |v ?)2 1
3 | lgpl-3.0 | lesser | (?:gnu )?lesser general public license (?:lgpl )?(?:version |v ?)3(?: 0)?
3 | lgpl-2.1 | lgpl/lgplv2 | lgpl ?(?:version |v ?)?2 1
3 | lgpl-3.0 | lgpl/lgplv3 | lgpl ?(?:version |v ?)?3(?: 0)?
3 | agpl-3.0 | affero | (?:gnu )?affero general public license (?:agpl )?(?:version |v ?)3(?: 0)?
3 | agpl-3.0 | agpl/agplv3 | agpl ?(?:version |v ?)?3(?: 0)?
3 | gfdl-1.2 | documentation | gnu free documentation license (?:version |v ?)1 2
3 | gfdl-1.3 | documentation | gnu free documentation license (?:version |v ?)1 3
3 | mpl-1.0 | mozilla | mozilla public license (?:version |v ?)?1 0
3 | mpl-1.1 | mozilla | mozilla public license (?:version |v ?)?1 1
3 | mpl-2.0 | mozilla | mozilla public license (?:version |v ?)?2 0
3 | mpl-2.0 | mpl/mplv2 | mpl ?(?:version |v ?)?2(?: 0)?
3 | epl-1.0 | eclipse | eclipse public license (?:version |v ?)?1 0
3 | epl-2.0 | eclipse | eclipse public license (?:version |v ?)?2 0
3 | eupl-1.1 | european | european union public licen[sc]e (?:eupl )?(?:version |v ?)?1 1
3 | eupl-1.2 | european | european union public licen[sc]e (?:eupl )?(?:version |v ?)?1 2
3 | cddl-1.0 | cddl | cddl (?:version |v ?)?1 0
3 | cddl-1.1 | cddl | cddl (?:version |v ?)?1 1
3 | bsd-2-clause | bsd | (?:(?:2|two) clause (?:simplified |freebsd )?bsd|bsd (?:2|two) clause)(?: licen[sc]e)?
3 | bsd-3-clause | bsd | (?:(?:3|three) clause (?:new |modified |revised )?bsd|bsd (?:3|three) clause)(?: licen[sc]e)?
3 | bsd-4-clause | bsd | (?:(?:4|four) clause (?:original )?bsd|bsd (?:4|four) clause)(?: licen[sc]e)?
3 | bsd-2-clause | bsd | (?:simplified|freebsd) bsd licen[sc]e
3 | bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[sc]e
3 | 0bsd | bsd/0bsd | (?:zero clause bsd|0bsd)(?: licen[sc]e)?
3 | artistic-1.0 | artistic | artistic license 1 0
3 | artistic-2.0 | artistic | artistic license 2 0
3 | afl-2.1 | academic | academic free license (?:version |v ?)?2 1
3 | afl-3.0 | academic | academic free license (?:version |v ?)?3 0
3 | osl-3.0 | open | open software license (?:version |v ?)?3 0
3 | bsl-1.0 | boost | boost software license (?:version |v ?)?1 0
3 | ofl-1.1 | ofl/sil | (?:sil )?(?:open font license|ofl) (?:version |v ?)?1 1
3 | cc0-1.0 | cc0 | cc0 1 0(?: universal)?
3 | cc-by-2.0 | cc | cc by 2 0
3 | cc-by-3.0 | cc | cc by 3 0
3 | cc-by-4.0 | cc | cc by 4 0
3 | cc-by-sa-3.0 | cc | cc by sa 3 0
3 | cc-by-sa-4.0 | cc | cc by sa 4 0
3 | cc-by-nc-4.0 | cc | cc by nc 4 0
3 | cc-by-nd-4.0 | cc | cc by nd 4 0
3 | cc-by-nc-sa-4.0 | cc | cc by nc sa 4 0
3 | cc-by-nc-nd-4.0 | cc | cc by nc nd 4 0
3 | cc-by-4.0 | attribution | creative commons attribution 4 0(?: international)?
3 | cc-by-3.0 | attribution | creative commons attribution 3 0(?: unported)?
3 | cc-by-sa-4.0 | attribution | creative commons attribution share ?alike 4 0(?: international)?
3 | cc-by-sa-3.0 | attribution | creative commons attribution share ?alike 3 0(?: unported)?
3 | cc-by-nc-4.0 | attribution | creative commons attribution non ?commercial 4 0(?: international)?
3 | cc-by-nc-sa-4.0 | attribution | creative commons attribution non ?commercial share ?alike 4 0(?: international)?
3 | zpl-2.1 | zope | zope public license (?:version |v ?)?2 1
3 | php-3.01 | php | php license (?:version |v ?)?3 01
3 | python-2.0 | python | python software foundation license version 2
3 | unicode-3.0 | unicode | unicode license v3
3 | cecill-2.1 | cecill | cecill (?:version |v ?)?2 1
3 | mulan-2.0 | mulan | mulan (?:psl|permissive software license) (?:version |v ?)?2
3 | busl-1.1 | business | business source license (?:version )?1 1
3 | sspl-1.0 | server | server side public license (?:version |v ?)?1
3 | elastic-2.0 | elastic | elastic license (?:version |v ?)?2(?: 0)?
3 | polyform-noncommercial-1.0 | polyform | polyform noncommercial license 1 0 0
3 | hippocratic-3.0 | hippocratic | hippocratic license (?:version |v ?)?3(?: 0)?
3 | llama-2 | llama | llama 2 community license
3 | llama-3 | llama | llama 3(?: \d)? community license
3 | openrail-m | openrail/rail | (?:bigscience |creativeml )?open ?rail m(?: licen[sc]e)?
4 | mit | mit | (?:the )?mit licen[sc]e
4 | mit | mit/expat | (?:mit|expat) (?:x11 )?licensed
4 | mit | mit | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit
4 | mit | expat | expat licen[sc]e
4 | apache | apache | (?:the )?apache (?:software )?licen[sc]e
4 | gpl | general | (?:the )?(?:gnu )?general public licen[sc]e
4 | gpl | gpl | (?:the )?(?:gnu )?gpl
4 | lgpl | lesser/library | (?:the )?(?:gnu )?(?:lesser|library) general public licen[sc]e
4 | lgpl | lgpl | (?:the )?(?:gnu )?lgpl
4 | agpl | affero | (?:the )?(?:gnu )?affero general public licen[sc]e
4 | agpl | agpl | (?:the )?(?:gnu )?agpl
4 | gfdl | documentation | (?:the )?(?:gnu )?free documentation licen[sc]e
4 | bsd | bsd | (?:the )?bsd (?:style |type |like )?licen[sc]ed?
4 | isc | isc | (?:the )?isc licen[sc]e
4 | mpl | mozilla | (?:the )?mozilla public licen[sc]e
4 | epl | eclipse | (?:the )?eclipse public licen[sc]e
4 | eupl | european | (?:the )?european union public licen[sc]e
4 | cddl | development | (?:the )?common development and distribution licen[sc]e
4 | cpl | common | (?:the )?common public licen[sc]e
4 | ipl | ibm | (?:the )?ibm public licen[sc]e
4 | artistic | artistic | (?:the )?artistic licen[sc]e
4 | perl | perl | (?:under )?the same terms as perl itself
4 | afl | academic | (?:the )?academic free licen[sc]e
4 | osl | open | (?:the )?open software licen[sc]e
4 | zlib | zlib | (?:the )?zlib(?: libpng)? licen[sc]e
4 | libpng | libpng | (?:the )?libpng licen[sc]e
4 | bsl-1.0 | boost | (?:the )?boost software licen[sc]e
4 | unlicense | unlicense | (?:the )?unlicense
4 | wtfpl | wtfpl | (?:the )?wtfpl
4 | ofl | font | (?:the )?(?:sil )?open font licen[sc]e
4 | ms-pl | microsoft | (?:the )?microsoft public licen[sc]e
4 | ms-rl | microsoft | (?:the )?microsoft reciprocal licen[sc]e
4 | apsl | apple | (?:the )?apple public source licen[sc]e
4 | ncsa | ncsa | (?:the )?(?:university of illinois )?ncsa open source licen[sc]e
4 | postgresql | postgresql | (?:the )?postgresql licen[sc]e
4 | php | php | (?:the )?php licen[sc]e
4 | ruby | ruby | (?:the )?ruby licen[sc]e
4 | python | python | (?:the )?(?:psf|python(?: software foundation)?) licen[sc]e
4 | openssl | openssl | (?:the )?openssl licen[sc]e
4 | x11 | x11 | (?:the )?x11 licen[sc]e
4 | vim | vim | (?:the )?vim licen[sc]e
4 | tcl | tcl | (?:the )?tcl tk licen[sc]e
4 | zpl | zope | (?:the )?zope public licen[sc]e
4 | w3c | w3c | (?:the )?w3c (?:software )?(?:notice and )?licen[sc]e
4 | ftl | freetype | (?:the )?freetype (?:project )?licen[sc]e
4 | cecill | cecill | (?:the )?cecill(?: [abc])? licen[sc]e
4 | odbl | database | (?:the )?open (?:data commons open )?database licen[sc]e
4 | odc-by | commons | (?:the )?open data commons attribution licen[sc]e
4 | pddl | commons | (?:the )?open data commons public domain dedication and licen[sc]e
4 | ogl | government | (?:the )?open government licen[sc]e
4 | cc | creative | (?:a |the )?creative commons licen[sc]e
4 | cc0-1.0 | cc0 | cc0
4 | cc-by | attribution | creative commons attribution(?: licen[sc]e)?
4 | cc-by-sa | attribution | creative commons attribution share ?alike(?: licen[sc]e)?
4 | cc-by-nc | attribution | creative commons attribution non ?commercial(?: licen[sc]e)?
4 | cc-by-nd | attribution | creative commons attribution no ?deriv(?:ative)?s(?: licen[sc]e)?
4 | cc-by-nc-sa | attribution | creative commons attribution non ?commercial share ?alike(?: licen[sc]e)?
4 | cc-by-nc-nd | attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[sc]e)?
4 | public-domain | domain | (?:dedicated to|placed in|released (?:in|into|to)|is in) the public domain
4 | proprietary | rights | all rights reserved (?:\S+ ){0,8}(?:confidential|proprietary)
4 | commercial | commercial | (?:under|with|requires) a (?:separate )?commercial licen[sc]e
4 | busl | business | (?:the )?business source licen[sc]e
4 | sspl | server | (?:the )?server side public licen[sc]e
4 | elastic | elastic | (?:the )?elastic licen[sc]e
4 | commons-clause | clause | commons clause
4 | polyform | polyform | polyform (?:\S+ ){0,3}licen[sc]e
4 | llama | llama | llama (?:\S+ ){0,2}community licen[sc]e
5 | other | licensed | (?:is |are )?licensed under(?: the)?(?: terms of the)?
5 | other | license | license (?:agreement|terms|notice|text|file)
5 | other | licence | licence (?:agreement|terms|notice|text|file)
5 | other | copying | see (?:the )?(?:file )?copying
5 | other | license | see (?:the )?(?:accompanying )?license(?: file| txt| md)?(?: for (?:more )?details)?
5 | other | warranty | without (?:any )?warranty of any kind
5 | other | warranties | without warranties or conditions of any kind
5 | other | reserved | all rights reserved
"""


class Rule(NamedTuple):
    level: int
    label: str
    keywords: tuple[str, ...]
    pattern: str


def parsed(text: str = TEXT) -> list[Rule]:
    """The rules of a text, in their order; blank lines are passed over."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        level, label, words, pattern = (x.strip() for x in line.split("|", 3))
        out.append(Rule(int(level), label, tuple(words.split("/")), pattern))
    return out


RULES = parsed()

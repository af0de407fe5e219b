"""Signatures written one by one: sentences by which licenses and notices are recognised.

A line is: label | priority | signature | keyword. In a signature a blank is
any gap between words; the rest is regex. Priorities: 6 the text names exactly
one license in a form made for it, 5 a sentence of one license's grant, 4 a
sentence of one license's conditions, 3 a sentence that several licenses of a
family share (the label is the family's), 2 a name or hint, 1 a bare notice.
A sentence of higher priority hides the weaker ones inside it, and a weak one
that runs on over it (``license-reference``) does not hide it.
"""

SIGNATURES = """
mit | 5 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction | hereby
mit | 4 | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software | substantial
mit | 3 | without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software | sublicense
mit | 3 | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise | tort
mit | 6 | opensource org licenses mit | opensource
mit-modern | 5 | permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software | royalty
mit-festival | 5 | permission is hereby granted free of charge to use and distribute this software and its documentation without restriction | documentation
mit-feh | 4 | the above copyright notice and this permission notice shall be included in all copies of the software and its documentation and acknowledgment shall be given | acknowledgment
x11 | 4 | except as contained in this notice the name of the x consortium shall not be used in advertising | consortium
x11 | 3 | except as contained in this notice the names? of .{1,80}? shall not be used in advertising or otherwise to promote the sale use or other dealings in this software | dealings
hpnd | 5 | permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted (?:without fee )?provided that the above copyright notice appears? in all copies | documentation
hpnd | 4 | makes no representations about the suitability of this software for any purpose it is provided as is without express or implied warranty | suitability
ntp | 5 | permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted | documentation
isc | 5 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies | permission
isc | 4 | shall .{1,40}? be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits | whatsoever
isc | 3 | disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness | disclaims
0bsd | 5 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is | permission
bsd-2 | 4 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided | redistributions
bsd | 4 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer | redistributions
bsd | 3 | redistributions in binary form must reproduce the above copyright notice | redistributions
bsd-3 | 5 | neither the names? of (?:the )?.{1,120}? nor the names of (?:its|any|other|the) contributors may be used to endorse or promote products derived from this software without specific prior written permission | endorse
bsd-3 | 4 | neither the name of the copyright holder nor the names of its contributors may be used | neither
bsd-4 | 5 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment | advertising
bsd-4 | 4 | this product includes software developed by the university of california berkeley and its contributors | berkeley
bsd-3-clear | 5 | no express or implied licenses to any party s patent rights are granted by this license | patent
bsd-patent | 5 | each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive | grants
bsd-3-nuclear | 5 | you acknowledge that this software is not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility | nuclear
bsd | 3 | this software is provided by the (?:copyright holders and contributors|regents and contributors|authors?) (?:and contributors )?as is and any express or implied warranties | regents|holders|author
bsd | 6 | opensource org licenses bsd license | opensource
bsd-2 | 6 | opensource org licenses bsd 2 clause | opensource
bsd-3 | 6 | opensource org licenses bsd 3 clause | opensource
apache-2 | 6 | www apache org licenses license 2 0 | apache
apache-2 | 6 | opensource org licenses apache 2 0 | opensource
apache-2 | 5 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license | compliance
apache-2 | 4 | you may not use this (?:file|work|software|project) except in compliance with the license | compliance
apache-2 | 4 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind | applicable
apache-2 | 4 | see the license for the specific language governing permissions and limitations under the license | governing
apache-2 | 4 | grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide | patent
apache-2 | 4 | you must cause any modified files to carry prominent notices stating that you changed the files | prominent
apache-1.1 | 5 | this product includes software developed by the apache software foundation | foundation
apache-1.1 | 4 | the names apache and apache software foundation must not be used to endorse or promote products | endorse
apache-1.0 | 5 | this product includes software developed by the apache group for use in the apache http server project | apache
apache-1.0 | 4 | products derived from this software may not be called apache nor may apache appear in their names without prior written permission of the apache group | apache
gpl | 4 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license | redistribute
gpl-2 | 5 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 2 | redistribute
gpl-3 | 5 | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version 3 | redistribute
gpl | 3 | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose | merchantability
gpl | 3 | you should have received a copy of the gnu general public license along with | received
gpl-2 | 4 | the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom | freedom
gpl-2 | 4 | gnu general public license terms and conditions for copying distribution and modification | copying
gpl-2 | 4 | activities other than copying distribution and modification are not covered by this license they are outside its scope | scope
gpl-3 | 4 | the gnu general public license is a free copyleft license for software and other kinds of works | copyleft
gpl-3 | 4 | no covered work shall be deemed part of an effective technological measure | technological
gpl-3 | 4 | you may convey verbatim copies of the program s source code as you receive it in any medium | convey
gpl | 2 | free software foundation inc 51 franklin st(?:reet)? fifth floor boston | franklin
gpl | 2 | free software foundation inc 59 temple place(?: suite 330)? boston | temple
gpl | 2 | free software foundation inc 675 mass ave cambridge | foundation
gpl-1 | 5 | gnu general public license version 1 february 1989 | february
gpl-2 | 6 | gnu general public license version 2 june 1991 | june
gpl-3 | 6 | gnu general public license version 3 29 june 2007 | june
gpl-2 | 6 | www gnu org licenses (?:old licenses )?gpl 2 0 | gnu
gpl-3 | 6 | www gnu org licenses gpl 3 0 | gnu
gpl | 4 | www gnu org licenses gpl | gnu
gpl-2-classpath | 5 | linking this library statically or dynamically with other modules is making a combined work based on this library | statically
gpl-2-classpath | 4 | as a special exception the copyright holders of this library give you permission to link this library with independent modules | exception
gpl-gcc-exception | 5 | gcc runtime library exception | gcc
gpl-autoconf-exception | 5 | as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf | autoconf
gpl-bison-exception | 5 | as a special exception you may create a larger work that contains part or all of the bison parser skeleton | bison
gpl-font-exception | 5 | if you create a document which uses this font and embed this font or unaltered portions of this font into the document | embed
gpl-linking-exception | 4 | link the code of portions of this program with the openssl library | openssl
linux-syscall-note | 5 | this copyright does not cover user programs that use kernel services by normal system calls | kernel
lgpl | 4 | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license | redistribute
lgpl-2.1 | 5 | (?:this (?:library|program|file) is free software you can redistribute it and or modify it )?under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 2 1 | lesser
lgpl-2 | 5 | (?:this library is free software you can redistribute it and or modify it )?under the terms of the gnu library general public license as published by the free software foundation (?:either )?version 2 | library
lgpl-3 | 5 | (?:this (?:library|program|file) is free software you can redistribute it and or modify it )?under the terms of the gnu lesser general public license as published by the free software foundation (?:either )?version 3 | lesser
lgpl-2.1 | 6 | gnu lesser general public license version 2 1 february 1999 | february
lgpl-2 | 6 | gnu library general public license version 2 june 1991 | june
lgpl-3 | 4 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license | incorporates
lgpl | 3 | you should have received a copy of the gnu (?:lesser|library) general public license along with | received
lgpl-2.1 | 6 | www gnu org licenses (?:old licenses )?lgpl 2 1 | gnu
lgpl-3 | 6 | www gnu org licenses lgpl 3 0 | gnu
agpl-3 | 5 | (?:this program is free software you can redistribute it and or modify it )?under the terms of the gnu affero general public license as published by the free software foundation (?:either )?version 3 | affero
agpl-3 | 4 | the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software | affero
agpl-3 | 4 | your modified version must prominently offer all users interacting with it remotely through a computer network | remotely
agpl-3 | 6 | www gnu org licenses agpl | gnu
agpl-1 | 5 | affero general public license version 1 march 2002 | affero
gfdl | 5 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | documentation
gfdl | 4 | with no invariant sections no front cover texts and no back cover texts | invariant
gfdl-no-invariant | 5 | gnu free documentation license version 1 [123] or any later version published by the free software foundation with no invariant sections | invariant
mpl-1.0 | 5 | subject to the netscape public license|subject to the mozilla public license version 1 0 the license you may not use this file except in compliance | subject
mpl-1.1 | 5 | the contents of this file are subject to the mozilla public license version 1 1 | contents
mpl-2 | 5 | this source code form is subject to the terms of the mozilla public license v 2 0 | mozilla
mpl-2 | 4 | if a copy of the mpl was not distributed with this file you can obtain one at https? mozilla org mpl 2 0 | mpl
mpl-2-incompatible | 4 | this source code form is incompatible with secondary licenses as defined by the mozilla public license | incompatible
mpl | 3 | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights | rights
mpl-tri | 5 | alternatively the contents of this file may be used under the terms of either the gnu general public license version 2 or later the gpl or the gnu lesser general public license version 2 1 or later | alternatively
npl-1.1 | 5 | the contents of this file are subject to the netscape public license | netscape
epl-1 | 5 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 | eclipse
epl-2 | 5 | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 | eclipse
epl-1 | 6 | www eclipse org legal epl v10 | eclipse
epl-2 | 6 | www eclipse org legal epl (?:2 0|v20) | eclipse
edl-1 | 5 | eclipse distribution license v ?1 0 | eclipse
epl | 3 | the accompanying program is provided under the terms of this eclipse public license agreement | accompanying
cpl | 5 | the accompanying program is provided under the terms of this common public license agreement | accompanying
ibm-pl | 5 | the accompanying program is provided under the terms of this ibm public license agreement | accompanying
cddl | 5 | the contents of this file are subject to the terms of the common development and distribution license | contents
cddl | 4 | you can obtain a copy of the license at usr src opensolaris license or www opensolaris org os licensing | opensolaris
cddl-gpl | 5 | the contents of this file are subject to the terms of either the gnu general public license version 2 only gpl or the common development and distribution license | contents
cecill | 5 | this software is governed by the cecill(?: [bc])? licen[cs]e under french law | cecill
cecill | 4 | ce logiciel est regi par la licence cecill | logiciel
eupl | 5 | licensed under the eupl version 1 [012] | eupl
osl-3 | 5 | licensed under the open software license version 3 0 | open
afl-3 | 5 | licensed under the academic free license version 3 0 | academic
artistic | 4 | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control | semblance
artistic-2 | 4 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed | establishes
perl | 5 | you can redistribute it and or modify it under the same terms as perl itself | perl
perl | 4 | this (?:library|module|program) is free software you (?:can|may) redistribute it and or modify it under the same terms as perl | perl
python | 5 | this license agreement is between the python software foundation psf and the individual or organization licensee | python
python | 4 | psf is making python available to licensee on an as is basis psf makes no representations or warranties | licensee
python-cnri | 5 | cnri open source gpl compatible license agreement | cnri
ruby | 5 | you may redistribute it and or modify it under either the terms of the 2 clause bsdl | bsdl
ruby | 4 | you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices | verbatim
php-3.01 | 5 | this source file is subject to version 3 01 of the php license | php
php-3 | 5 | this source file is subject to version 3 0 of the php license | php
php | 4 | this product includes php software freely available from | php
zend | 5 | this source file is subject to version 2 00 of the zend license | zend
zlib | 5 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software | arising
zlib | 4 | the origin of this software must not be misrepresented you must not claim that you wrote the original software | misrepresented
zlib | 4 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software | misrepresented
libpng | 5 | this code is released under the libpng license | libpng
libpng | 4 | the contributing authors and group 42 inc disclaim all warranties | disclaim
libtiff | 5 | permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that i the above copyright notices and this permission notice appear in all copies | notices
curl | 5 | curl and libcurl are licensed under a mit x derivate license | curl
ijg | 5 | this software is based in part on the work of the independent jpeg group | jpeg
openssl | 5 | this product includes software developed by the openssl project for use in the openssl toolkit | toolkit
openssl | 4 | the names openssl toolkit and openssl project must not be used to endorse or promote products derived from this software | toolkit
ssleay | 5 | this product includes cryptographic software written by eric young | cryptographic
ssleay | 4 | this library is free for commercial and non commercial use as long as the following conditions are aheared to | aheared
boost | 5 | distributed under the boost software license version 1 0 | boost
boost | 5 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license | accompanying
boost | 6 | www boost org license 1 0 txt | boost
unlicense | 5 | this is free and unencumbered software released into the public domain | unencumbered
unlicense | 4 | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary | compile
unlicense | 6 | unlicense org | unlicense
wtfpl | 4 | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed | permitted
wtfpl | 4 | you just do what the fuck you want to | fuck
beerware | 5 | as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer in return | beer
json | 5 | the software shall be used for good not evil | evil
cc0 | 5 | to the extent possible under law .{1,120}? has waived all copyright and related or neighboring rights to this work | neighboring
cc0 | 6 | creativecommons org publicdomain zero 1 0 | publicdomain
cc0 | 4 | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders | irrevocably
cc-pdm | 6 | creativecommons org publicdomain mark 1 0 | publicdomain
cc | 3 | the licensor permits others to copy distribute display and perform the work | licensor
cc | 3 | the work as defined below is provided under the terms of this creative commons public license | creative
cc-by | 4 | you must give appropriate credit provide a link to the license and indicate if changes were made | appropriate
cc-by-sa | 4 | if you remix transform or build upon the material you must distribute your contributions under the same license as the original | remix
cc-by-nd | 4 | if you remix transform or build upon the material you may not distribute the modified material | remix
cc-by-nc | 4 | you may not use the material for commercial purposes | commercial
cc | 2 | some rights reserved | reserved
odbl | 5 | this .{1,60}? is made available under the open database license | database
odbl | 6 | opendatacommons org licenses odbl | opendatacommons
odc-by | 6 | opendatacommons org licenses by 1 0 | opendatacommons
pddl | 6 | opendatacommons org licenses pddl | opendatacommons
dbcl | 5 | any rights in individual contents of the database are licensed under the database contents license | database
ofl-1.1 | 5 | this font software is licensed under the sil open font license version 1 1 | font
ofl-1.1 | 4 | the fonts and derivatives however cannot be released under any other type of license | derivatives
ofl-1.1 | 4 | neither the font software nor any of its individual components in original or modified versions may be sold by itself | font
ubuntu-font | 5 | ubuntu font licen[cs]e(?: version)? 1 0 | ubuntu
bitstream-vera | 5 | the font software may be modified altered or added to and in particular the designs of glyphs or characters in the fonts may be modified | glyphs
ms-pl | 5 | this license governs use of the accompanying software if you use the software you accept this license | governs
ms-pl | 4 | the software is licensed as is you bear the risk of using it the contributors give no express warranties guarantees or conditions | guarantees
ms-rl | 5 | for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file along with a copy of this license | recipients
ms-eula | 4 | these license terms are an agreement between microsoft corporation or based on where you live one of its affiliates and you | microsoft
sspl | 5 | if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available | functionality
busl | 5 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work | licensor
busl | 4 | effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licensed work | anniversary
elastic | 5 | you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features | hosted
commons-clause | 5 | the license does not grant to you the right to sell the software|commons clause license condition | sell|commons
polyform-nc | 5 | polyform noncommercial license 1 0 0 | polyform
polyform-sb | 5 | polyform small business license 1 0 0 | polyform
polyform-shield | 5 | polyform shield license 1 0 0 | polyform
prosperity | 5 | prosperity public license 3 0 0 | prosperity
parity | 5 | parity public license 7 0 0 | parity
hippocratic | 5 | hippocratic license(?: version)? [23] [01] | hippocratic
anti-996 | 5 | anti 996 license version 1 0 | 996
ncsa | 5 | neither the names of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission university of illinois | illinois
ncsa | 4 | permission is hereby granted free of charge to any person obtaining a copy .{1,200}? university of illinois | illinois
upl | 5 | the universal permissive license upl version 1 0 subject to the condition set forth below permission is hereby granted | permissive
w3c | 5 | by obtaining using and or copying this work you the licensee agree that you have read understood and will comply with the following terms | licensee
w3c-document | 5 | public documents on the w3c site are provided by the copyright holders under the following license | w3c
unicode | 5 | unicode inc license agreement data files and software | unicode
unicode | 4 | copyright .{1,30}? unicode inc all rights reserved distributed under the terms of use | unicode
icu | 5 | icu license icu 1 8 1 and later | icu
oasis | 4 | oasis open all rights reserved all capitalized terms in the following text have the meanings assigned to them in the oasis intellectual property rights policy | oasis
ietf-trust | 5 | this document is subject to bcp 78 and the ietf trust s legal provisions relating to ietf documents | ietf
ietf | 4 | code components extracted from this document must include simplified bsd license text | extracted
sgi-b | 5 | sgi free software license b version 2 0 | sgi
sun-rpc | 5 | users may copy or modify sun rpc without charge but are not authorized to license or distribute it to anyone else | rpc
sleepycat | 5 | redistributions in any form must be accompanied by information on how to obtain complete source code for the db software | accompanied
sendmail | 5 | use modification and redistribution including distribution of any modified or derived work of the source code or executable files of the sendmail | sendmail
info-zip | 5 | for the purposes of this copyright and license info zip is defined as the following set of individuals | individuals
bzip2 | 5 | this program bzip2 the associated library libbzip2 and all documentation are copyright | bzip2
sqlite | 5 | the author disclaims copyright to this source code in place of a legal notice here is a blessing | blessing
blessing | 4 | may you do good and not evil may you find forgiveness for yourself and forgive others may you share freely never taking more than you give | forgiveness
tcl | 5 | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained in all copies | retained
postgresql | 5 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted | agreement
vim | 5 | vim is charityware you can use and copy it as much as you like | charityware
latex-lppl | 5 | it may be distributed and or modified under the conditions of the latex project public license | latex
latex-lppl | 4 | this work has the lppl maintenance status | lppl
knuth | 4 | this file may be freely copied and distributed provided that no changes whatsoever are made | whatsoever
fsf-unlimited | 5 | this (?:configure script|file) is free software the free software foundation gives unlimited permission to copy and or distribute it | unlimited
fsf-all-permissive | 5 | copying and distribution of this file with or without modification are permitted in any medium without royalty | royalty
llama | 5 | llama (?:2|3|3 1|3 2) is licensed under the llama (?:2|3|3 1|3 2) community license | llama
llama | 4 | you will not use the llama materials or any output or results of the llama materials to improve any other large language model | llama
gemma | 5 | gemma is provided under and subject to the gemma terms of use | gemma
openrail | 4 | you agree not to use the model or derivatives of the model in any way that violates any applicable national federal state local or international law | derivatives
openrail | 4 | use based restrictions as referenced in paragraph 5 must be included as an enforceable provision | enforceable
bigscience-rail | 5 | bigscience rail license v1 0 | bigscience
deepseek | 5 | deepseek license agreement version 1 0 | deepseek
qwen | 5 | tongyi qianwen license agreement | qianwen
nvidia-eula | 5 | license agreement for nvidia software development kits | nvidia
intel-simplified | 5 | intel simplified software license | intel
oracle-bcl | 5 | oracle binary code license agreement | oracle
oracle-nftc | 5 | oracle no fee terms and conditions | oracle
adobe | 4 | adobe systems incorporated all rights reserved .{0,60}? adobe grants you a non exclusive | adobe
apple-apsl | 5 | this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license | apple
apple-mit | 4 | in consideration of your agreement to abide by the following terms and subject to these terms apple grants you a personal non exclusive license | apple
rpl | 5 | reciprocal public license 1 [15] | reciprocal
qpl | 5 | this file may be distributed under the terms of the q public license | public
sissl | 5 | sun industry standards source license | sun
watcom | 5 | sybase open watcom public license | watcom
ecl | 5 | licensed under the educational community license version 2 0 | educational
mulan | 5 | licensed under mulan psl v2 you can use this software according to the terms and conditions of the mulan psl v2 | mulan
ogl-uk | 5 | contains public sector information licensed under the open government licen[cs]e v[123] 0 | sector
ogl-canada | 5 | open government licen[cs]e canada | canada
dl-de-by | 5 | datenlizenz deutschland namensnennung version 2 0 | datenlizenz
etalab | 5 | licence ouverte (?:open licence )?(?:etalab )?(?:version )?[12] 0 | ouverte
gutenberg | 5 | this e ?book is for the use of anyone anywhere (?:in the united states and most other parts of the world )?at no cost and with almost no restrictions whatsoever | whatsoever
gutenberg | 4 | under the terms of the project gutenberg license included with this | gutenberg
wikipedia | 4 | text is available under the creative commons attribution share ?alike license additional terms may apply | additional
stackexchange | 4 | user contributions licensed under cc by sa | contributions
us-government | 4 | this (?:work|software|document) (?:is|was) (?:a work of|produced by|prepared by) the (?:u s|united states) government and is not subject to copyright | government
us-government | 3 | pursuant to title 17 section 105 of the united states code this software is not subject to copyright protection and is in the public domain | pursuant
crown | 3 | contains crown copyright | crown
dual | 3 | dual licensed under (?:the )?(?:terms of )?(?:both )?the mit and gpl licenses | dual
dual | 3 | licensed under either of apache license version 2 0 or mit license at your option | option
evaluation | 4 | for evaluation (?:purposes )?only and may not be used in production | evaluation
academic-only | 4 | for academic (?:research )?(?:use|purposes) only | academic
research-only | 4 | for (?:non commercial )?research (?:use|purposes) only | research
no-derivatives | 3 | no part of this (?:publication|book|work|document) may be reproduced stored in a retrieval system or transmitted in any form or by any means | retrieval
no-ai-training | 4 | (?:may not|must not|shall not) be used (?:for the purpose of|for|to) train(?:ing)? (?:any )?(?:artificial intelligence|machine learning|ai|large language) (?:technologies|models?|systems) | train
trade-secret | 3 | contains (?:confidential and )?proprietary (?:information|and trade secret information) of | proprietary
trade-secret | 3 | this (?:source )?code is (?:the )?confidential and proprietary | confidential
export | 2 | may be subject to (?:the )?(?:u s )?export (?:control|administration) (?:laws|regulations) | export
trademark | 1 | (?:is a|are) (?:registered )?trademarks? of | trademark
patent-pending | 1 | patents? pending | patent
terms-of-use | 1 | use of this (?:site|website|service) is subject to (?:our|the) terms of (?:use|service) | terms
license-reference | 1 | (?:this|the) (?:file|software|document|package|project|code|library|program) (?:is|are|may be) .{0,160}? licen[cs]e | licen
license-file | 1 | see (?:the )?(?:accompanying )?(?:file )?(?:license|copying)(?: txt| md)?(?: file)? for (?:details|more information|the full text|licensing) | license|copying
copyright | 1 | copyright (?:by )?the (?:authors?|contributors) | copyright
copyright | 1 | copyrighted (?:material|work|software) | copyrighted
""".strip().splitlines()

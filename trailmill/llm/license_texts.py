"""Fixed values of operator 1: the sentences of well-known license texts and notices, in their order.

Every line is one sentence as the license has it. A sentence that several texts share has the
identifier of the first. ``CORES`` says how many of the first sentences of a text tell it already.
"""

from __future__ import annotations

TEXTS = {
    "MIT": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
    "MIT-0": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
""",
    "BSD-3-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "BSD-2-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "0BSD": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
""",
    "Zlib": """
This software is provided 'as-is', without any express or implied warranty.
In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented;
you must not claim that you wrote the original software.
If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
This notice may not be removed or altered from any source distribution.
""",
    "Unlicense": """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.
We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.
We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
""",
    "BSL-1.0": """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
""",
    "WTFPL": """
Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.
You just DO WHAT THE FUCK YOU WANT TO.
""",
    "Apache-2.0": """
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.
""",
    "Apache-2.0 text": """
"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.
"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.
"Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity.
"You" (or "Your") shall mean an individual or Legal Entity exercising permissions granted by this License.
"Source" form shall mean the preferred form for making modifications, including but not limited to software source code, documentation source, and configuration files.
"Object" form shall mean any form resulting from mechanical transformation or translation of a Source form, including but not limited to compiled object code, generated documentation, and conversions to other media types.
"Work" shall mean the work of authorship, whether in Source or Object form, made available under the License, as indicated by a copyright notice that is included in or attached to the work (an example is provided in the Appendix below).
"Contributor" shall mean Licensor and any individual or Legal Entity on behalf of whom a Contribution has been received by Licensor and subsequently incorporated within the Work.
Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.
You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:
You must give any other recipients of the Work or Derivative Works a copy of this License;
You must cause any modified files to carry prominent notices stating that You changed the files;
This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.
""",
    "GPL-3.0-or-later": """
This program is free software:
you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program.
""",
    "GPL-2.0-or-later": """
This program is free software;
you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;
either version 2 of the License, or (at your option) any later version.
""",
    "GPL-2.0-only": """
This program is free software;
you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.
""",
    "GPL-3.0 text": """
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
The GNU General Public License is a free, copyleft license for software and other kinds of works.
The licenses for most software and other practical works are designed to take away your freedom to share and change the works.
By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users.
""",
    "GPL-2.0 text": """
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
The licenses for most software are designed to take away your freedom to share and change it.
By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.
""",
    "LGPL-3.0 text": """
This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.
As used herein, "this License" refers to version 3 of the GNU Lesser General Public License, and the "GNU GPL" refers to version 3 of the GNU General Public License.
"The Library" refers to a covered work governed by this License, other than an Application or a Combined Work as defined below.
""",
    "LGPL-2.1 text": """
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
The licenses for most software are designed to take away your freedom to share and change it.
By contrast, the GNU General Public Licenses are intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.
This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it.
You can use it too, but we suggest you first think carefully about whether this license or the ordinary General Public License is the better strategy to use in any particular case, based on the explanations below.
""",
    "AGPL-3.0 text": """
The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.
The licenses for most software and other practical works are designed to take away your freedom to share and change the works.
""",
    "LGPL-3.0-or-later": """
This library is free software:
you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
""",
    "LGPL-2.1-or-later": """
This library is free software;
you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;
either version 2.1 of the License, or (at your option) any later version.
""",
    "AGPL-3.0-or-later": """
This program is free software:
you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
""",
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "EPL-2.0": """
This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/
""",
    "CC0-1.0": """
To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.
This software is distributed without any warranty.
You should have received a copy of the CC0 Public Domain Dedication along with this software.
""",
    "CC-BY-4.0 text": """
By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License ("Public License").
""",
    "CC-BY-SA-4.0 text": """
By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License ("Public License").
""",
}

#: Sentences at the start of a text that are enough to tell it; the others need all of theirs.
CORES = {"MIT": 2, "BSD-3-Clause": 4, "BSD-2-Clause": 3, "ISC": 1, "Zlib": 3, "Unlicense": 1, "BSL-1.0": 1, "Apache-2.0": 3, "Apache-2.0 text": 2, "GPL-3.0-or-later": 2, "CC0-1.0": 1, "MIT-0": 1, "0BSD": 1, "GPL-3.0 text": 2, "GPL-2.0 text": 2, "LGPL-3.0 text": 1, "LGPL-2.1 text": 4, "AGPL-3.0 text": 1}

#: Licenses whose text leaves open whether later versions hold.
TEXT_NAMES = {"GPL-3.0": "GPL-3.0-only", "GPL-2.0": "GPL-2.0-only", "LGPL-3.0": "LGPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "AGPL-3.0": "AGPL-3.0-only"}

#: Names under which licenses are told in one phrase, and the licenses; a last word "License" may be left out.
NAMES = {
    "MIT License": "MIT", "MIT/Expat": "MIT", "Expat License": "MIT", "Apache License, Version 2.0": "Apache-2.0", "Apache License 2.0": "Apache-2.0", "Apache License v2.0": "Apache-2.0", "Apache 2.0": "Apache-2.0", "Apache-2.0": "Apache-2.0", "Apache Software License 2.0": "Apache-2.0",
    "BSD 3-Clause License": "BSD-3-Clause", "3-Clause BSD": "BSD-3-Clause", "New BSD License": "BSD-3-Clause", "Modified BSD License": "BSD-3-Clause", "BSD 2-Clause License": "BSD-2-Clause", "2-Clause BSD": "BSD-2-Clause", "Simplified BSD License": "BSD-2-Clause", "ISC License": "ISC", "zlib License": "Zlib", "Boost Software License 1.0": "BSL-1.0",
    "Boost Software License, Version 1.0": "BSL-1.0", "GNU General Public License, version 3": "GPL-3.0-only", "GNU General Public License v3.0": "GPL-3.0-only", "GNU GPL v3": "GPL-3.0-only", "GPLv3": "GPL-3.0-only", "GPL v3": "GPL-3.0-only", "GPL-3.0": "GPL-3.0-only",
    "GNU General Public License, version 2": "GPL-2.0-only", "GNU General Public License v2.0": "GPL-2.0-only", "GNU GPL v2": "GPL-2.0-only", "GPLv2": "GPL-2.0-only", "GPL v2": "GPL-2.0-only", "GPL-2.0": "GPL-2.0-only", "GPLv3+": "GPL-3.0-or-later", "GPLv2+": "GPL-2.0-or-later",
    "GNU General Public License, version 3 or later": "GPL-3.0-or-later", "GNU General Public License, version 2 or later": "GPL-2.0-or-later", "GNU Lesser General Public License, version 3": "LGPL-3.0-only", "LGPLv3": "LGPL-3.0-only", "LGPL-3.0": "LGPL-3.0-only",
    "GNU Lesser General Public License, version 2.1": "LGPL-2.1-only", "LGPLv2.1": "LGPL-2.1-only", "LGPL-2.1": "LGPL-2.1-only", "GNU Affero General Public License, version 3": "AGPL-3.0-only", "AGPLv3": "AGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only",
    "Mozilla Public License, version 2.0": "MPL-2.0", "Mozilla Public License 2.0": "MPL-2.0", "MPL 2.0": "MPL-2.0", "MPL-2.0": "MPL-2.0", "Eclipse Public License 2.0": "EPL-2.0", "Eclipse Public License v2.0": "EPL-2.0", "Unlicense": "Unlicense", "WTFPL": "WTFPL",
    "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC BY 4.0": "CC-BY-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0", "CC0 1.0": "CC0-1.0", "CC0": "CC0-1.0", "Creative Commons Attribution 4.0 International License": "CC-BY-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
}
#: What is licensed, and in which words.
THINGS = ("project", "work", "software", "code", "source code", "file", "program", "library", "package", "module", "document", "repository", "content", "data", "dataset")
WAYS = ("released", "licensed", "distributed", "available", "made available", "provided", "published", "relicensed", "licenced")
#: What a line begins with that tells licenses by their short names, the names, older ones, and exceptions.
TAG = "SPDX-License-Identifier"
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BlueOak-1.0.0", "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "CC-BY-3.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "FSFAP", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0-only", "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "HPND", "ICU", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MPL-2.0-no-copyleft-exception", "MS-PL", "NCSA", "OFL-1.1", "OpenSSL", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0",
    "Unicode-DFS-2016", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)
OLD_SPDX = {
    "GPL-1.0": "GPL-1.0-only", "GPL-1.0+": "GPL-1.0-or-later", "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.0": "LGPL-2.0-only", "LGPL-2.0+": "LGPL-2.0-or-later", "LGPL-2.1": "LGPL-2.1-only",
    "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-only", "AGPL-3.0+": "AGPL-3.0-or-later",
}
EXCEPTIONS = ("Linux-syscall-note", "Classpath-exception-2.0", "GCC-exception-2.0", "GCC-exception-3.1", "LLVM-exception", "Autoconf-exception-2.0", "Autoconf-exception-3.0", "Bison-exception-2.2", "Font-exception-2.0", "Libtool-exception", "OCaml-LGPL-linking-exception", "Qt-GPL-exception-1.0", "u-boot-exception-2.0", "WxWindows-exception-3.1")
#: Other sentences that tell something by themselves, and lines that only reserve rights.
OTHERS = {"This file is in the public domain.": "Public-Domain", "This work is in the public domain.": "Public-Domain", "This software is in the public domain.": "Public-Domain"}
RIGHTS, RESERVED = ("All rights reserved.", "All Rights Reserved"), "Proprietary"

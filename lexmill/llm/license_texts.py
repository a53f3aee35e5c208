"""Texts of well-known public licences, as templates of the licence scan: fixed values."""

from __future__ import annotations

from itertools import product

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.'
_BOOST = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_END = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_GPL_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."

_FSF = "Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_APACHE_HEAD = 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'
_MPL_HEAD = 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'

# The conditions of Creative Commons licences as they are written, and their sets.
CONDITIONS = {"nc": ("NonCommercial", "Non-Commercial"), "nd": ("NoDerivatives", "NoDerivs", "No-Derivatives"), "sa": ("ShareAlike", "Share-Alike")}
CONDITION_SETS = ((), ("nc",), ("nd",), ("sa",), ("nc", "nd"), ("nc", "sa"))


def _words(text: str) -> str:
    return text.lower().replace("-", " ")


def _creative_commons() -> list[tuple[str, str, str]]:
    out = []
    for has in CONDITION_SETS:
        label = "-".join(("cc-by", *has))
        out.append((label, _words(" ".join(("cc by", *has))), f"Licensed under CC {'-'.join(('BY', *(x.upper() for x in has)))} 4.0"))
        for spelt in product(*[CONDITIONS[x] for x in has]):
            name = "-".join(("Attribution", *spelt))
            out.append((label, _words(f"creative commons {name}"), f"This work is licensed under a Creative Commons {name} 4.0 International License"))
            out.append((label, _words(f"creative commons {name}"), f"Creative Commons {name} 4.0"))
    return out


def forbidden(label: str) -> list[str]:
    """Phrases, as words, beside which a place is another licence: conditions that the label lacks, and names of the
    licences whose names hold this one's."""
    if label.startswith("cc-by"):
        has = label.split("-")[2:]
        spelt = [_words(x) for c, forms in CONDITIONS.items() if c not in has for x in forms]
        return spelt + [_words(" ".join(("by", *more))) for more in CONDITION_SETS if len(more) == len(has) + 1 and set(has) < set(more)]
    return {"gpl": ["lesser general public license", "library general public license", "affero general public license"], "bsd": ["mentioning features or use"]}.get(label, [])


#: Words that may stand within a short notice without changing what it says, and words before it that turn it round.
FILLERS = frozenset("the a an of terms and conditions this work version v its all".split())
NEGATIONS = frozenset("not never no isn aren wasn weren unlike neither nor instead rather except without formerly previously".split())

#: Label, mandatory key phrase, text. A notice that is often given alone stands beside the whole text.
TEMPLATES = [
    ("apache-2.0", "apache license version 2 0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "apache license version 2 0", _APACHE),
    ("apache-2.0", "apache license version 2 0", f"{_APACHE} {_APACHE_END}"),
    ("mit", "mit license", "Released under the MIT License"),
    ("mit", "to deal in the software without restriction", _MIT),
    ("mit", "to deal in the software without restriction", f"{_MIT} {_AS_IS}"),
    ("bsd", "redistribution and use in source and binary forms", _BSD.split(":")[0]),
    ("bsd", "redistribution and use in source and binary forms", f"{_BSD} {_BSD_END}"),
    ("bsd", "redistribution and use in source and binary forms", f"{_BSD} {_BSD_NAMES} {_BSD_END}"),
    ("isc", "permission to use copy modify and or distribute", _ISC),
    ("isc", "permission to use copy modify and or distribute", f"{_ISC} {_ISC_END}"),
    ("zlib", "altered source versions must be plainly marked", _ZLIB),
    ("bsl-1.0", "machine executable object code", _BOOST),
    ("gpl", "gnu general public license", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "gnu general public license", _GPL),
    ("gpl", "gnu general public license", f"{_GPL} {_GPL_END}"),
    ("lgpl", "gnu lesser general public license", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "released into the public domain", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "released into the public domain", _UNLICENSE),
    ("gpl", "gnu general public license", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_FSF}"),
    ("gpl", "gnu general public license", "Licensed under the GNU General Public License"),
    ("lgpl", "gnu lesser general public license", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 {_FSF}"),
    ("lgpl", "gnu lesser general public license", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "gnu affero general public license", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 {_FSF}"),
    ("agpl", "gnu affero general public license", _GPL.replace("GNU General", "GNU Affero General")),
    ("agpl", "gnu affero general public license", "Licensed under the GNU Affero General Public License"),
    ("apache-2.0", "apache license version 2 0", _APACHE_HEAD),
    ("mpl-2.0", "mozilla public license", _MPL_HEAD),
    *_creative_commons(),
]

#: Frequent English words; each counts as if it stood in every text of a background as large as the templates are many.
BACKGROUND = """the of and to in is that for it with as was on be at by this are from or an not have has had his her their they you we
he she all will would there can may if one no what when which who how more any such other than then so these some only into out up
do does made make use used time work new over under about between after before also its our your been being were but my me him them
where most many much each both first two three year years people way well even because through just like own see same while should
could now here very part place case number world hand high long little life right left old great state system program group general""".split()

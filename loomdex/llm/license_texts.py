"""License texts and notices in template markup, and one-line mentions.  The wording is the licences' own and is a fixed value.

``<<optional>> ... <<end>>`` may be left out; ``<<any N>>`` stands for up to N words;
``<<one a|b c>>`` stands for one of the alternatives.  Words are compared as the scan cuts them:
lower case, letters and digits only, so punctuation in a template carries no weight.
"""

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
<<one authors or copyright holders|copyright holders|authors>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""

_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
<<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY <<any 12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any 12>>
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str) -> str:
    """The notice that the licence asks for at the head of a file."""
    program = "<<one program|library|file|software>>"
    return f"""<<one this|the>> {program} is free software <<optional>>you can redistribute it and/or modify it<<end>>
    under the terms of the {name} as published by the Free Software Foundation <<optional>>either<<end>> version <<one 1|2|2.1|3>> of the License
    <<optional>>or (at your option) any later version<<end>> <<one this|the>> {program} is distributed in the hope that it will be useful, but WITHOUT
    ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
    <<optional>>You should have received a copy of the {name} along with this {program} <<optional>>If not, see <<any 8>><<end>><<end>>"""


#: label: texts and notices that a document must hold in full
TEMPLATES = {
    "MIT": [
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of <<one this software and associated documentation files|this software>>
        <<optional>>(the "Software")<<end>>, to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>>
        shall be included in all copies or substantial portions of the Software. {_AS_IS}""",
    ],
    "ISC": [
        """Permission to use, copy, modify, <<one and/or|and>> distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<any 12>> DISCLAIMS ALL WARRANTIES
        WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "BSD-2-Clause": [f"{_BSD_GRANT} {_BSD_WARRANTY}"],
    "BSD-3-Clause": [
        f"""{_BSD_GRANT} <<optional>>3.<<end>> Neither the name of <<any 20>> nor the names of <<one its contributors|contributors>> may be used to endorse or promote products
        derived from this software without specific prior written permission. {_BSD_WARRANTY}"""
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the <<one authors|author>> be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions: <<optional>>1.<<end>> The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. <<optional>>2.<<end>> Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. <<optional>>3.<<end>> This notice may not be removed or altered from any source distribution."""
    ],
    "Unlicense": [
        f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
        software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that
        recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
        this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law.
        {_AS_IS} <<optional>>For more information, please refer to <<any 6>><<end>>"""
    ],
    "Apache-2.0": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
        of the License at <<any 12>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
        and limitations under the License."""
    ],
    "GPL": [_gnu("GNU General Public License")],
    "LGPL": [_gnu("GNU <<one lesser|library>> General Public License")],
    "AGPL": [_gnu("GNU Affero General Public License")],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can
        obtain one at <<any 8>>"""
    ],
    "CC0-1.0": ["To the extent possible under law, <<any 20>> has waived all copyright and related or neighboring rights to <<any 12>>"],
} | {
    f"CC-BY{part}-4.0": [
        f"""This <<any 8>> is licensed under <<one a|the>> Creative Commons Attribution{long} 4.0 <<optional>>International<<end>> License
        <<optional>>To view a copy of this license, visit <<any 12>><<end>>"""
    ]
    for part, long in {"": "", "-SA": " ShareAlike", "-NC": " NonCommercial", "-ND": " NoDerivatives", "-NC-SA": " NonCommercial ShareAlike", "-NC-ND": " NonCommercial NoDerivatives"}.items()
}

_UNDER = "<<one released|licensed|distributed|available|published>> under <<optional>>the terms of<<end>>"

#: label: one-line statements that name a licence without its wording; a weaker kind of its own
MENTIONS = {
    "MIT": [f"{_UNDER} <<optional>>the<<end>> MIT <<one license|licence>>"],
    "Apache-2.0": [f"{_UNDER} the Apache <<one license|licence>> <<optional>>version<<end>> 2.0"],
    "GPL": [f"{_UNDER} the GNU General Public License <<one version|v>> <<one 2|3>> <<optional>>0<<end>>"],
    "CC0-1.0": [f"{_UNDER} <<optional>>a<<end>> <<optional>>creative commons<<end>> CC0 1.0", "dedicated to the public domain under <<optional>>creative commons<<end>> CC0 1.0"],
} | {
    f"CC-BY{part}-4.0": [f"{_UNDER} <<optional>>a<<end>> <<optional>>creative commons<<end>> CC BY{part} 4.0"]
    for part in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND")
}

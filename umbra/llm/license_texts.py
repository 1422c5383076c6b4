"""Public licence texts, notice lines and equivalent spellings.

The texts are the published licences themselves; the spelling pairs are those of the
public matching guidelines for licence lists.  More can be added without other changes.
"""

#: Words and phrases (canonical form) that count as the same; replaced left to right.
EQUIVALENT = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("merchantability", "merchantability"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("organise", "organize"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT_BODY = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS
_ISC_HEAD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

LICENSES = {
    "MIT": [_MIT_BODY, "MIT License\n" + _MIT_BODY, "The MIT License (MIT)\n" + _MIT_BODY],
    "ISC": [_ISC_HEAD + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL, "ISC License\n" + _ISC_HEAD + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL],
    "0BSD": [_ISC_HEAD + ".\n" + _ISC_TAIL, "BSD Zero Clause License\n" + _ISC_HEAD + ".\n" + _ISC_TAIL],
    "BSD-2-Clause": [_BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL],
    "BSD-3-Clause": [h + _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL for h in ("", "BSD 3-Clause License\n")],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
}

#: One-line notices that stand for a licence.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Apache License 2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights.", "Dedicated to the public domain under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
}

#: Canonical digests of longer published texts (made by op3_license from the texts themselves): as published, in the
#: layout of the licence list where it differs, and without what follows the terms.
DIGESTS = {
    "Apache-2.0": [
        "01bae72428daaa79c11a657b3ce6735f5b0057878a890789bcbb7db20083a61e",
        "23c0498e738b86da84fa1ffb1ff43f4ef103f365367077ada18cd1db1813d6da",
        "81e9b74a977a0320a7f1118705e033ed557f3f7d1e88cac937c574ad075941aa",
        "98378616989e23431b15181388a001fdeac0999db741918e302c5162392bcfbd",
        "b0552a470b35ebc6a8191e79a1840fa5a6ae46978f1b8a1dbb6eb94002fbbeb2",
        "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b",
    ],
    "Artistic-1.0-Perl": [
        "f273930184a9b8de03336e9ae5d74bef291165524044f55455ee5117f494811a",
    ],
    "CC-BY-SA-4.0": [
        "def99b23ba8930a02c111ffb99c0c4f55f9fd9bb38ad3ffe9df58fde3aac4247",
    ],
    "CC0-1.0": [
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ],
    "GFDL-1.2": [
        "37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f",
    ],
    "GFDL-1.3": [
        "7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4",
    ],
    "GPL-1.0": [
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c",
    ],
    "GPL-2.0": [
        "031ce0347a7bfaa9fea9fb34dc0def0f70d366e9b6aeab50cf9537178d0d9d50",
        "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017",
        "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75",
        "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1",
        "c2eea7a9d82a254e540a96d8107801d93d00bcef2742a78b7e8e8d0c0efcbd1c",
        "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999",
    ],
    "GPL-3.0": [
        "27c7d4a052cb5b68f1b41c3fa933ce9796ace78aeed0819833b4f8102a6eb47b",
        "59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349",
        "607c705f9768e313af3bc7846c6815e61bce971f831a5fd61344a150e8f32b08",
        "69a19fa00710a84d83ec8e9bb9b15c7f42c9598b02028ac43f385e2eb740206b",
        "f37d587507fc579524cb06d1130d5899891a978ee008cfc033b3b4d95da28bee",
        "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975",
    ],
    "LGPL-2.0": [
        "96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d",
        "a07313094d4e63b099417491ebc80c933bf85c36d5afddbf13be9a11457c8513",
        "a745f6517e6dd821b7e0352067dcf8f32789a02694b661bfad965280370e9b1a",
    ],
    "LGPL-2.1": [
        "22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e",
        "4656c6936fdab5334aa4c4800c6a7881ffce24f3abb1f578c24da0bbb2735d0a",
        "bfe8e5dc6cef43d0c4777d9c1891f596159cda682ef40545ad2105f66b9746f1",
    ],
    "LGPL-3.0": [
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MPL-1.1": [
        "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61",
    ],
    "MPL-2.0": [
        "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
    ],
}

"""Telephone numbering plan: calling code -> pattern of a valid national number.

Compiled from the public national numbering plans (North American Numbering Plan
area-code assignments, Ofcom, ARCEP, BNetzA, ...). A number whose calling code is
not listed is reported as not covered; callers can pass another plan. +886 is
left to the rules for Taiwan's own numbers.
``0?`` stands where people write the trunk prefix after the calling code.
"""

# Assigned North American codes by first digit: geographic (US, Canada, Caribbean,
# Pacific), toll-free, premium and personal numbers. The exchange that follows
# never starts with 0 or 1. 523 and 524 are assigned except for their exchange 555.
NANP_AREA = (
    "(?:2(?:0[1-9]|1[02-9]|2[03-9]|3[14569]|4[02689]|5[0-46]|6[0234789]|7[02469]|8[1349])"
    "|3(?:0[1-9]|1[02-9]|2[013-79]|3[0-24679]|4[013567]|5[0-47]|6[013-5789]|8[0256])"
    "|4(?:0[1-9]|1[02-9]|2[3-58]|3[0124578]|4[0-3578]|5[08]|6[3489]|7[0234589]|8[04])"
    "|5(?:0[0-9]|1[02-9]|2[0-25-9]|3[01349]|4[0148]|5[179]|6[1-467]|7[0-579]|8[0-24-8])"
    "|6(?:0[1-9]|1[02-9]|2[034689]|3[0169]|4[015679]|5[016789]|6[0-2479]|7[0128]|8[0-4689])"
    "|7(?:0[1-9]|1[02-9]|2[014-8]|3[0-247]|4[0237]|5[3478]|6[023579]|7[0-589]|8[0124-7])"
    "|8(?:0[0-9]|1[02-9]|2[015689]|3[0-3589]|4[03-5789]|5[04-9]|6[02-9]|7[0236-9]|88)"
    "|9(?:0[0-9]|1[02-9]|2[0589]|3[0146-9]|4[0-35789]|5[12469]|7[0-389]|8[03-69]))"
)
NANP = rf"(?:{NANP_AREA}[2-9]\d{{6}}|52[34](?:[2-46-9]\d{{2}}|5(?:[0-46-9]\d|5[0-46-9]))\d{{4}})"

NUMBERING_PLAN = {
    "1": NANP,
    "7": r"(?:[3489]\d{9}|7\d{9})",
    "20": r"0?(?:2\d{8}|[13]\d{7,8}|[4-9]\d{7,8}|1[0125]\d{8})",
    "27": r"0?[1-8]\d{8}",
    "30": r"(?:2\d{9}|6[89]\d{8}|800\d{7})",
    "31": r"0?(?:[1-57]\d{8}|6[1-58]\d{7}|8[58]\d{7})",
    "32": r"0?(?:[1-9]\d{7}|4[5-9]\d{7})",
    "33": r"0?[1-9]\d{8}",
    "34": r"(?:[5-9]\d{8})",
    "36": r"(?:06)?(?:1\d{7}|[235-7]0\d{7}|[2-9]\d{7})",
    "39": r"(?:0\d{5,10}|3\d{8,9}|8\d{5,9})",
    "40": r"0?[237]\d{8}",
    "41": r"0?[2-9]\d{8}",
    "43": r"0?(?:1\d{6,12}|[2-7]\d{5,12}|6[5-9]\d{7,11})",
    "44": r"0?(?:2(?:0[01378]|3[0189]|4[017]|8[0-46-9]|9[0-2])\d{7}|1\d{8,9}|3\d{9}|7[1-57-9]\d{8}|8\d{9}|5[56]\d{8}|9\d{9}|70\d{8}|76\d{8})",
    "45": r"[2-9]\d{7}",
    "46": r"0?(?:[1-689]\d{6,8}|7[02369]\d{7}|10\d{7})",
    "47": r"[2-9]\d{7}",
    "48": r"(?:[1-9]\d{8})",
    "49": r"0?(?:[2-9]\d{5,12}|1[5-7]\d{8,9})",
    "51": r"0?(?:1\d{7}|[4-8]\d{7}|9\d{8})",
    "52": r"(?:[2-9]\d{9}|1[1-9]\d{9})",
    "54": r"0?(?:[1-3]\d{9}|9[1-3]\d{9}|[68]\d{9})",
    "55": r"0?(?:[1-9][1-9][2-5]\d{7}|[1-9][1-9]9\d{8})",
    "56": r"(?:[2-9]\d{8})",
    "57": r"(?:60[124-8]\d{7}|3\d{9})",
    "60": r"0?(?:1[02-46-9]\d{7}|11\d{8}|3\d{8}|[4-79]\d{7}|8\d{7})",
    "61": r"0?(?:[2378]\d{8}|4\d{8}|1[38]00\d{6})",
    "62": r"0?(?:8[1-35-9]\d{7,10}|2[124]\d{7,8}|[2-9]\d{6,10})",
    "63": r"0?(?:9\d{9}|2\d{7,8}|[3-8]\d{7,8})",
    "64": r"0?(?:[34679]\d{7}|2\d{7,9}|800\d{6,7})",
    "65": r"(?:[3689]\d{7})",
    "66": r"0?(?:2\d{7}|[3-7]\d{7}|[689]\d{8})",
    "81": r"0?(?:[1-9]\d{8}|[5-9]0\d{8}|120\d{6})",
    "82": r"0?(?:2\d{7,8}|1[0-9]\d{7,8}|[3-6]\d{7,9}|70\d{8})",
    "84": r"0?(?:[35789]\d{8}|2\d{9})",
    "86": r"0?(?:1[3-9]\d{9}|10\d{8}|2\d{9}|[3-9]\d{9,10})",
    "90": r"0?(?:[2-4]\d{9}|5\d{9}|8\d{9})",
    "91": r"0?(?:[6-9]\d{9}|[1-5]\d{9}|1800\d{6,7})",
    "92": r"0?(?:3\d{9}|[2-9]\d{8,9})",
    "351": r"(?:[2379]\d{8}|800\d{6})",
    "352": r"(?:[2-9]\d{4,10})",
    "353": r"0?(?:1\d{7}|8[2-9]\d{7}|[2-9]\d{7,9})",
    "354": r"(?:[4-9]\d{6}|3\d{8})",
    "358": r"0?(?:[1-9]\d{4,11})",
    "380": r"0?[3-9]\d{8}",
    "420": r"(?:[2-9]\d{8})",
    "421": r"0?(?:2\d{8}|[3-5]\d{8}|9\d{8})",
    "852": r"(?:[2-9]\d{7})",
    "853": r"(?:[268]\d{7})",
    "855": r"0?(?:[1-9]\d{7,8})",
    "880": r"0?(?:1[3-9]\d{8}|[2-9]\d{6,9})",
    "966": r"0?(?:5\d{8}|1[1-7]\d{7})",
    "971": r"0?(?:5\d{8}|[2-79]\d{7})",
    "972": r"0?(?:5\d{8}|[23489]\d{7}|7\d{8})",
    "977": r"0?(?:9[6-8]\d{8}|1\d{7}|[2-9]\d{7})",
}

# The other calling codes that are assigned by the ITU. No national rule is known here for them: a number is accepted with
# 6 to 12 digits behind the code, as long as the plan allows.
OTHER_CODES = (
    "53 58 93 94 95 98 "
    "211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 "
    "245 246 247 248 249 250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 269 290 291 297 298 299 "
    "350 355 356 357 359 370 371 372 373 374 375 376 377 378 379 381 382 383 385 386 387 389 423 "
    "500 501 502 503 504 505 506 507 508 509 590 591 592 593 594 595 596 597 598 599 "
    "670 672 673 674 675 676 677 678 679 680 681 682 683 685 686 687 688 689 690 691 692 "
    "800 808 850 856 870 878 881 882 883 960 961 962 963 964 965 967 968 970 973 974 975 976 979 992 993 994 995 996 998"
).split()
NUMBERING_PLAN |= {code: r"\d{6,12}" for code in OTHER_CODES}

# ITU calling codes by length: one digit, two digits, else three.
CALLING_CODE = "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"


def plan_pattern(plan: dict[str, str] = NUMBERING_PLAN) -> str:
    """One Java regex over ``+`` and digits that accepts every number of ``plan``."""
    return r"^\+(?:" + "|".join(f"{code}{national}" for code, national in plan.items()) + r")$"

"""Calling codes and lengths of national numbers (ITU E.164), and what is dialled before them."""

from __future__ import annotations

# Calling codes with the regions that use them, by the lengths of their national numbers (public numbering plans).
LENGTHS = {
    (4, 5): "290 SH TA",
    (4, 5, 6, 7): "690 TK",
    (4, 5, 6, 7, 8, 9, 10, 11): "352 LU",
    (4, 5, 6, 7, 8, 9, 10, 11, 12, 13): "43 AT",
    (4, 7): "683 NU",
    (5,): "500 FK, 682 CK",
    (5, 6): "247 AC, 672 NF AQ",
    (5, 6, 7): "685 WS, 688 TV",
    (5, 6, 7, 8, 9, 10): "263 ZW",
    (5, 6, 7, 8, 9, 10, 11, 12): "358 FI AX",
    (5, 7): "676 TO, 677 SB, 678 VU",
    (5, 8): "686 KI, 47 NO SJ",
    (6,): "298 FO, 299 GL, 508 PM, 681 WF, 687 NC",
    (6, 7): "597 SR",
    (6, 7, 8): "53 CU",
    (6, 7, 8, 9): "252 SO, 355 AL, 359 BG, 595 PY",
    (6, 7, 8, 9, 10): "378 SM, 880 BD",
    (6, 7, 8, 9, 10, 11): "39 IT VA",
    (6, 7, 8, 9, 10, 11, 12, 13): "49 DE",
    (6, 8): "689 PF",
    (6, 8, 9): "376 AD",
    (7,): "220 GM, 238 CV, 239 ST, 246 IO, 248 SC, 269 KM, 291 ER, 297 AW, 501 BZ, 592 GY, 673 BN, 674 NR, 679 FJ, 680 PW, 691 FM, 692 MH, 960 MV",
    (7, 8): "241 GA, 267 BW, 372 EE, 507 PA, 599 CW BQ, 670 TL, 675 PG, 961 LB, 975 BT",
    (7, 8, 9): "231 LR, 243 CD, 967 YE",
    (7, 8, 9, 10): "46 SE, 84 VN, 95 MM, 254 KE, 353 IE",
    (7, 8, 9, 10, 11, 12): "62 ID, 86 CN",
    (7, 8, 10): "230 MU, 234 NG",
    (7, 9): "245 GW, 265 MW, 354 IS, 423 LI",
    (8,): "45 DK, 65 SG, 216 TN, 222 MR, 223 ML, 226 BF, 227 NE, 228 TG, 232 SL, 235 TD, 236 CF, 253 DJ, 257 BI, 266 LS, 268 SZ, 350 GI, 356 MT, 357 CY, 370 LT, 371 LV, 373 MD, 374 AM, "
    "386 SI, 387 BA, 389 MK, 502 GT, 503 SV, 504 HN, 505 NI, 506 CR, 509 HT, 591 BO, 598 UY, 852 HK, 853 MO, 965 KW, 968 OM, 973 BH, 974 QA, 976 MN, 993 TM",
    (8, 9): "32 BE, 36 HU, 51 PE, 66 TH, 213 DZ, 218 LY, 224 GN, 237 CM, 250 RW, 258 MZ, 264 NA, 377 MC, 381 RS, 382 ME, 383 XK, 385 HR, 593 EC, 855 KH, 886 TW, 962 JO, 963 SY, 970 PS, 971 AE, 972 IL",
    (8, 9, 10): "20 EG, 60 MY, 63 PH, 64 NZ, 856 LA, 964 IQ, 977 NP",
    (8, 9, 10, 11): "82 KR",
    (8, 10): "229 BJ, 850 KP",
    (9,): "27 ZA, 31 NL, 33 FR, 34 ES, 40 RO, 41 CH, 48 PL, 56 CL, 61 AU CC CX, 94 LK, 93 AF, 211 SS, 212 MA EH, 221 SN, 233 GH, 240 GQ, 242 CG, 244 AO, 249 SD, 251 ET, 255 TZ, 256 UG, 260 ZM, 261 MG, "
    "262 RE YT, 351 PT, 375 BY, 380 UA, 420 CZ, 421 SK, 590 GP BL MF, 594 GF, 596 MQ, 966 SA, 992 TJ, 994 AZ, 995 GE, 996 KG, 998 UZ",
    (9, 10): "44 GB GG IM JE, 81 JP, 92 PK",
    (10,): "1 US CA AG AI AS BB BM BS DM DO GD GU JM KN KY LC MP MS PR SX TC TT VC VG VI, 7 RU KZ, 30 GR, 52 MX, 57 CO, 58 VE, 90 TR, 91 IN, 98 IR, 225 CI",
    (10, 11): "54 AR, 55 BR",
}
# What is dialled before a national number inside a region, where it is not 0 (empty: nothing); regions whose national
# numbers may begin with 0; what is dialled before a calling code, where it is not 00.
TRUNK = {"RU": "8", "KZ": "8", "BY": "8", "LT": "8", "HU": "06", "MX": "", "ES": "", "PT": "", "IT": "", "VA": "", "SM": "", "GR": "", "DK": "", "NO": "", "SJ": "", "PL": "", "CZ": "", "CI": "", "SG": "", "HK": ""}
ZERO_FIRST = {"39", "378", "225", "241", "242"}
INTERNATIONAL = {"US": "011", "CA": "011", "AU": "0011", "RU": "810", "KZ": "810", "BY": "810", "JP": "010", "HK": "001", "SG": "000|001", "TH": "001", "KR": "00[1-8]|00", "BR": "00(?:1[245]|2[1-3]|31|4[13])"}
# The pattern of valid national numbers where more is asked than a length.
PATTERNS = {"1": r"[2-9]\d{2}[2-9]\d{6}", "33": r"[1-9]\d{8}", "34": r"[5-9]\d{8}", "44": r"[1-9]\d{8,9}", "7": r"[3-9]\d{9}", "91": r"[1-9]\d{9}"}


def codes() -> dict[str, tuple[int, ...]]:
    """Lengths of national numbers by calling code. No code begins another, so the longest prefix is the only one."""
    return {entry.split()[0]: lengths for lengths, entries in LENGTHS.items() for entry in entries.split(", ")}


def regions() -> dict[str, str]:
    """Calling codes by region."""
    return {region: entry.split()[0] for entries in LENGTHS.values() for entry in entries.split(", ") for region in entry.split()[1:]}

"""Plain-Python counterparts of the operators' text rules."""

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)

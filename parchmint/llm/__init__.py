"""Operations of a training-data pipeline (language, licences, tokens, duplicates, mixing, personal data, URLs).

Nothing outside this subpackage imports it.
"""

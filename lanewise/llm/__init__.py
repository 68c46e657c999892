"""Operations of a training-data pipeline: filtering, de-duplication, mixing, packing, search.

Nothing outside this subpackage imports it.
"""

"""The packing rule written as a plain loop over samples, to compare the jobs with."""


def greedy(sizes, seq_length, cap):
    """[(pack contents as sample indices)] in the order packs are finished."""
    finished, held, used = [], [], 0
    for i, size in enumerate(sizes):
        if size > seq_length:
            finished.append([i])
            continue
        if held and (used + size > seq_length or len(held) + 1 > cap):
            finished.append(held)
            held, used = [], 0
        held.append(i)
        used += size
    return finished + ([held] if held else [])


def packed_row(samples, members, seq_length, num_slots, pad):
    """Padded arrays of one pack, sample by sample and token by token."""
    ids, segments, positions = [], [], []
    for ordinal, member in enumerate(members):
        for slot, tokens in enumerate(samples[member]):
            for position, token in enumerate(tokens):
                ids.append(token)
                segments.append(ordinal * num_slots + slot)
                positions.append(position)
    ids, segments, positions = ids[:seq_length], segments[:seq_length], positions[:seq_length]
    missing = seq_length - len(ids)
    return {
        "input_ids": ids + [pad] * missing,
        "attention_mask": [1] * len(ids) + [0] * missing,
        "segment_ids": segments + [-1] * missing,
        "position_ids": positions + [0] * missing,
        "num_segments": len(members),
    }

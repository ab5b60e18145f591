"""NDJSON lines and files shared by the tests of the log engine."""

import os


def write_lines(path, lines, newline="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as fh:
        fh.write(newline.join(lines) + newline)


SAMPLE = [
    '-- log rotated --',
    '{"level":"DEBUG"}',
    '{"time":1719835200,"level":"NOTICE","msg":"valve opened at 40_bar"}',
    '{"msg":"pump stalled","level":"ALARM",":topic":"plant-7",":time":"2024-06-30 08:15:00","study_uid":"run_42"}',
    '{"accession":"Q-118","time":"2024-06-29T21:40:05Z","msg":"pump started","level":"DEBUG"}',
]

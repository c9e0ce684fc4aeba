"""Readers and writers: corpus scans, sample/metric/eval tables, vocabulary
files, and the binary token-stream and packed-chunk formats (Python Data
Sources)."""

"""Readers: file trees, Git histories and refs, blame, diffs and coverage files."""

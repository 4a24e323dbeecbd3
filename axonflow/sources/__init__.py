"""Readers and writers of experiment sheets, clocks, raw recordings, designs and results."""

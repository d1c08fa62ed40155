"""Streaming lane over an index log: an extension of ours, batch semantics stay the measure."""

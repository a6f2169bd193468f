"""Where tables come from: file trees, git, coverage and timing reports."""

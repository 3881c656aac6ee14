"""Where frames come from and go: readers, named collections, versions, cursors, dynamic documents."""
